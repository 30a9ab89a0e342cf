"""Byte-level BPE over arrays of code points.

Boundaries of the pre-tokens come from a finite automaton. Each code point has
a class, each class is a transition function on the automaton's states, and the
functions under composition make a small monoid, found once by closure. Since
composition is associative, the state before every code point is a prefix scan:
blocks are scanned side by side, then the blocks' own products, and no regular
expression and no loop over characters is needed. A boundary follows from the
state before a code point, its class and the next one's.

The slices between boundaries are looked up in a bounded cache; new ones are
merged together, one merge for each in a round, by rank tables of pairs. Ids
are returned with the byte offset at which each ends, so any range of a
document decodes on its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._scan import slices
from ._tables import documents

# classes of code points
LETTER, ONE, RV, ELL, EE, NUMBER, OTHER, QUOTE, BLANK, WHITE, END = range(11)
# states after a code point; CUT: at a text's start
CUT, GAP, SPACE, WORD, DIGITS, MARKS, QUOTED, HALF_RV, HALF_L, SHORT = range(10)

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers of Unicode 16 that Python's own tables (15.1) do not have yet, as first and last code points.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)], np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[WHITE_SPACE] = WHITE
    out[0x20] = BLANK
    for chars, kind in (("stmd", ONE), ("rv", RV), ("l", ELL), ("e", EE), ("'", QUOTE)):
        out[[ord(c) for c in chars]] = kind
    return out


def step(state: int, kind: int) -> int:
    """The automaton's transition."""
    if kind in (NUMBER, OTHER, BLANK, WHITE, END):
        return {NUMBER: DIGITS, OTHER: MARKS, BLANK: SPACE, WHITE: GAP, END: CUT}[kind]
    if kind == QUOTE:  # a quote may open a contraction only where it opens a token
        return MARKS if state in (MARKS, SPACE, QUOTED) else QUOTED
    if state == QUOTED:
        return {ONE: SHORT, RV: HALF_RV, ELL: HALF_L}.get(kind, WORD)
    return SHORT if (state, kind) in ((HALF_RV, EE), (HALF_L, ELL)) else WORD


def opens(state: int, kind: int, following: int) -> bool:
    """Whether a token starts at a code point of this class, after this state and before that class."""
    if state == CUT or kind == END:
        return True
    if kind in (BLANK, WHITE):
        return state not in (GAP, SPACE) or following not in (BLANK, WHITE, END)
    if kind == NUMBER:
        return state not in (DIGITS, SPACE)
    if kind in (OTHER, QUOTE):
        return state not in (MARKS, SPACE, QUOTED)
    if state == QUOTED:
        return not (kind == ONE or (kind, following) in ((RV, EE), (ELL, ELL)))
    return state not in (SPACE, WORD, HALF_RV, HALF_L)


class Scanner:
    """Pre-token boundaries by a scan over the monoid of transition functions."""

    def __init__(self):
        self.classes = classes()
        functions = [tuple(step(s, k) for s in range(10)) for k in range(11)]
        known = {f: i for i, f in reversed(list(enumerate(functions)))}
        members = list(functions)
        at = 0
        while at < len(members):
            for g in functions:
                made = tuple(g[s] for s in members[at])
                if made not in known:
                    known[made] = len(members)
                    members.append(made)
            at += 1
        n = len(members)
        assert n <= 256
        self.apply = np.array(members, np.uint8)
        self.then = np.array([[known[tuple(g[s] for s in f)] for g in members] for f in members], np.uint8)
        self.generator = np.array([known[f] for f in functions], np.uint8)
        self.size = n
        self.opens = np.array([[[opens(s, k, f) for f in range(11)] for k in range(11)] for s in range(10)], bool).ravel()

    def prefix(self, own: np.ndarray, block: int = 64) -> np.ndarray:
        """The product of own[0..i] for each i."""
        n = len(own)
        if n <= block:
            out = own.copy()
            for i in range(1, n):
                out[i] = self.then[out[i - 1], own[i]]
            return out
        rows = -(-n // block)
        padded = np.zeros(rows * block, np.uint8)
        padded[:n] = own
        table, then = padded.reshape(rows, block).T.copy(), self.then.ravel()
        for i in range(1, block):
            table[i] = then[table[i - 1].astype(np.int32) * self.size + table[i]]
        before = self.prefix(table[-1])[:-1].astype(np.int32) * self.size
        table[:, 1:] = then[before + table[:, 1:]]
        return table.T.reshape(-1)[:n]

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Where tokens start, given classes that begin a text and end with END."""
        state = np.empty(len(kinds), np.uint8)
        state[0] = CUT
        state[1:] = self.apply[self.prefix(self.generator[kinds])[:-1], CUT]
        following = np.append(kinds[1:], np.uint8(END))
        return np.flatnonzero(self.opens[(state.astype(np.int32) * 11 + kinds) * 11 + following])


class Pairs:
    """Ranks of pairs of ids in a table with open addressing."""

    BITS = 21
    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        values = np.array(rank, np.int64)
        self.bits = max(self.BITS, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, self.NONE, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Codec:
    """Encodes and decodes by a rank file; ``entries`` bounds the cache of slices, which is emptied when it is full."""

    LONG = 200

    def __init__(self, path: str, entries: int = 700_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.scanner, self.pairs, self.entries = Scanner(), Pairs(self.ranks), entries
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, r in self.ranks.items():
            tokens[r] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.cache = _Slices()
        self.ids = np.zeros(1 << 20, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 18, np.int64)
        self.count = np.zeros(1 << 18, np.int64)

    def merge_long(self, word: bytes) -> list[int]:
        """Merges of a long slice by a queue of pairs."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        parts = [bytes([b]) for b in word]
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], ids[i], parts[j] = a + b, r, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := self.ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(queue, (q, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (q := self.ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(queue, (q, h, parts[h], parts[i]))
        return [x for x, p in zip(ids, parts, strict=True) if p is not None]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        counts = np.ones(len(words), np.int64)
        known = [self.ranks.get(w, -1) for w in words]
        done: dict[int, list[int]] = {}
        todo = []
        for i, r in enumerate(known):
            if r < 0:
                if len(words[i]) > self.LONG:
                    done[i] = self.merge_long(words[i])
                    counts[i] = len(done[i])
                else:
                    todo.append(i)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        if todo:
            sizes = np.array([len(words[i]) for i in todo])
            ids = self.byte[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)]
            row = np.repeat(np.array(todo), sizes)
            while len(ids):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                rank = np.full(len(ids), self.pairs.NONE, np.int64)
                rank[:-1] = np.where(row[1:] == row[:-1], self.pairs.rank(ids[:-1], ids[1:]), self.pairs.NONE)
                best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
                live = best >> 32 < self.pairs.NONE
                at = best[live] & 0xFFFFFFFF
                ids[at] = best[live] >> 32
                stay = np.ones(len(ids), bool)
                stay[at + 1] = False
                over = np.repeat(~live, np.diff(first, append=len(ids)))
                if over.any():
                    finished.append((row[over], ids[over]))
                    stay &= ~over
                ids, row = ids[stay], row[stay]
        for r, _ in finished:
            which, n = np.unique(r, return_counts=True)
            counts[which] = n
        out = np.zeros(int(counts.sum()), np.int32)
        start = np.cumsum(counts) - counts
        single = np.array(known) >= 0
        out[start[single]] = np.array(known)[single]
        for r, own in finished:
            change = np.flatnonzero(np.diff(r, prepend=-1))
            out[start[r] + np.arange(len(r)) - np.repeat(change, np.diff(change, append=len(r)))] = own
        for i, own in done.items():
            out[start[i] : start[i] + len(own)] = own
        return out, counts

    def _learn(self) -> None:
        new, self.cache.new = self.cache.new, []
        ids, counts = self.merge([w.encode() for w in new])
        while len(self.cache) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        where = slice(len(self.cache) - len(new), len(self.cache))
        self.count[where] = counts
        self.start[where] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if len(self.cache) > self.entries:
            self._reset()
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
        kinds = self.scanner.classes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        kinds[ends] = END
        starts = self.scanner.starts(kinds)
        stops = np.append(starts[1:], len(joined))
        own = kinds[starts] != END
        starts, stops = starts[own], stops[own]
        at = np.fromiter(map(self.cache.__getitem__, [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]), np.int64, len(starts))
        if self.cache.new:
            self._learn()
        per = self.count[at]
        total = np.cumsum(per)
        ids = self.ids[np.repeat(self.start[at] - (total - per), per) + np.arange(int(total[-1]) if len(total) else 0)]
        upto = np.append(0, total)[np.searchsorted(starts, ends)]
        return ids, np.diff(upto, prepend=0)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        size = self.token_len[ids]
        end = np.cumsum(size)
        return self.blob[np.repeat(self.token_start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


class _Slices(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self[text] = at = len(self)
        self.new.append(text)
        return at


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec in each Python worker, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts) * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(values.astype("<i4").tobytes())])


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids and ends of ``docs`` (doc_id, text), both binary: little-endian 32-bit ids, and the byte at which each ends.

    A null or empty text has no ids; repeated rows are encoded each; other
    columns are ignored.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            c = codec(path)
            ids, counts = c.encode([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum(c.token_len[ids])
            last = np.cumsum(counts)
            before = np.append(0, ends)[last - counts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _binaries(ids, counts), _binaries(ends - np.repeat(before, counts), counts)], names=["doc_id", "ids", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, ends binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and bytes (binary) from encode()'s ids."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", 2 << 20):
            data = [codec(path).decode(np.frombuffer(x, "<i4")).tobytes() for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids in decimal and of the bytes that they decode to."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", 2 << 20):
            rows: list[tuple] = []
            for x in part.column("ids").to_pylist():
                ids = np.frombuffer(x, "<i4")
                rows.append((len(ids), hashlib.sha256(str(ids.tolist())[1:-1].replace(",", "").encode()).hexdigest(), hashlib.sha256(codec(path).decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, decoded and digested. Nulls, repeats, long texts and empty tables: see encode() and digests()."""
    return digests(encode(documents(spark, sf_dir)))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
SQL: dict[str, str] = {}

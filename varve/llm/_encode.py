"""Encoding with the tokenizers library through a bounded cache of pieces that the library has encoded.

Texts are cut at single spaces and single line feeds. The two vocabularies in
use never merge across such a cut: one drops white space, the other lets a
space open the next token and a line feed between other characters stand alone.
Only where more white space stands beside a cut does it depend on what lies
around it; such a text is not cut at line feeds, or goes to the library as a
whole. The vocabulary that drops white space also lower-cases and parts letters
from marks, so its texts are cut there, too, on bytes, and only words and runs of
marks are cached. With the other, a new piece that is letters and then marks is
put together from the two. So a word costs the library one call whatever marks
follow it.

The cache has two generations: once the younger is full it becomes the older,
and the one before goes. A piece that comes again moves to the younger, so
frequent pieces stay and rare ones leave.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from ._scan import SPACE, text_bytes

#: Letters of Latin-1.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: ASCII marks but the apostrophe, which may open a token with letters.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Kinds of bytes: white space, letters, marks (which differ from letters in both bits), others.
_KIND = np.full(256, 4, np.uint8)
_KIND[SPACE] = 0
_SPACES = bytes(np.flatnonzero(SPACE).tolist())
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[list(_MARKS.encode())] = 2
#: A line feed with other white space beside it.
_WIDE = re.compile(r"\n(?:\s|(?<=\s\n))")
#: Bytes that an entry takes besides its text.
_ENTRY = 150


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of texts cut at white space and between letters and marks, in lower case, and how many each text has.

    A capital letter before a character beyond Latin-1 stays, as the two may be
    composed before they are lower-cased.
    """
    raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
    raw, kind = raw.copy(), _KIND[raw]
    lead = np.flatnonzero(raw == 0xC3)  # of the letters from U+00C0 on, and of two marks
    second = raw[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    lead, second = lead[letter] + 1, second[letter]
    kind[lead - 1] = kind[lead] = 1
    simple = np.append((raw[1:] < 0x80) | (raw[1:] == 0xC3), True)  # what follows is never composed with what stands before
    raw += ((raw - np.uint8(65) < 26) & simple[: len(raw)]).view(np.uint8) << 5
    lead = lead[(second < 0x9F) & simple[lead]]
    raw[lead] += 32
    ink = kind != 0
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | (kind[1:] ^ kind[:-1] == 3)
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = ink[at]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    sizes = np.diff(np.searchsorted(first, offsets))
    bounds = np.append(0, np.cumsum(last + 1 - first))
    pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(raw.tobytes().translate(None, _SPACES)))
    return pieces.dictionary_encode(), sizes  # each different piece is looked up once


class _Pieces(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at

    def places(self, different: np.ndarray) -> np.ndarray:
        """The places of pieces that differ from each other; those not seen yet get the next ones."""
        at = np.fromiter(map(self.get, different, repeat(-1)), np.int64, len(different))
        unknown = np.flatnonzero(at < 0)
        at[unknown] = np.arange(len(self), len(self) + len(unknown))
        new = different[unknown].tolist()
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.new += new
        return at


class _Generation:
    """Pieces by their place, and the ids of each."""

    def __init__(self):
        self.pieces = _Pieces()
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = self.bytes = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.odd = np.zeros(1 << 16, bool)

    def room(self) -> None:
        while len(self.pieces) > len(self.start):
            self.start, self.count, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.odd))

    def store(self, at: np.ndarray, ids: np.ndarray, per: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[at] = per
        self.start[at] = self.used + np.cumsum(per) - per
        self.used += len(ids)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places one after another, and how many each has."""
        per = self.count[at].astype(np.int64)
        return self.ids[np.repeat(self.start[at] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))], per


class Encoder:
    """encode(texts) -> (ids, counts): the ids of all texts one after another, and how many each has.

    ``spaces``: whether the vocabulary keeps white space (byte-level) or drops it.
    ``cache_bytes`` bounds each generation of the cache.
    """

    def __init__(self, path: str, spaces: bool, cache_bytes: int = 64 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces, self.cache_bytes = spaces, cache_bytes
        # the same model for lower-case ASCII words, which the normaliser leaves as they are and no pattern parts
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = WhitespaceSplit()
        self.lettered = f"^ ?[{_LETTERS}]+$" if spaces else f"^[{_SMALL}]+$"
        vocabulary = self.tokenizer.get_vocab()
        # a token that opens a word with its space, or one that closes a word
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token[0] == "Ġ" if spaces else token.endswith("</w>")
        self.feed = vocabulary.get("Ċ", -1)
        self.now, self.old = _Generation(), _Generation()

    def _learn(self) -> None:
        while self.now.pieces.new:  # the parts of joined pieces are new ones, too
            self._learn_new()

    def _learn_new(self) -> None:
        now = self.now
        pieces, new = now.pieces, now.pieces.new
        pieces.new = []
        at = len(pieces) - len(new)
        now.room()
        own = pa.array(new, pa.string())
        now.bytes += _ENTRY * len(new) + own.nbytes
        former = np.fromiter(map(self.old.pieces.get, new, repeat(-1)), np.int64, len(new))
        if (known := np.flatnonzero(former >= 0)).size:
            now.store(at + known, *self.old.take(former[known]))
            now.odd[at + known] = self.old.odd[former[known]]
        stem = pc.utf8_rtrim(own, characters=_MARKS) if self.spaces else own
        flags = lambda a: a.to_numpy(zero_copy_only=False)
        unknown, lettered, whole = former < 0, flags(pc.match_substring_regex(stem, self.lettered)), flags(pc.equal(stem, own))
        rest = np.flatnonzero(unknown & ~lettered).tolist()
        parted = np.flatnonzero(unknown & lettered & ~whole)
        words = unknown & lettered & whole
        # words one after another are one call to the library, and their tokens show where each begins or ends
        if self.spaces:
            behind = flags(pc.starts_with(own, " "))
            kinds = ((words & behind, "", self.tokenizer), (words & ~behind, "\n", self.tokenizer))
        else:
            plain = flags(pc.string_is_ascii(own))
            kinds = ((words & plain, " ", self.lean), (words & ~plain, " ", self.tokenizer))
        for chosen, between, tokenizer in kinds:
            places = np.flatnonzero(chosen).tolist()
            for i in range(0, len(places), 1024):
                part = places[i : i + 1024]
                ids = np.array(tokenizer.encode_batch_fast([between.join([new[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
                if between == "\n":
                    feed = ids == self.feed
                    made, which, found = ids[~feed], np.cumsum(feed)[~feed], int(feed.sum()) + 1
                else:
                    edge = self.edge[ids]
                    made, which, found = ids, np.cumsum(edge) - (1 if self.spaces else edge), int(edge.sum())
                    found = -1 if len(ids) and not edge[0 if self.spaces else -1] else found
                if found == len(part):
                    now.store(at + np.array(part), made, np.bincount(which, minlength=len(part)))
                else:
                    rest += part
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            made = self.tokenizer.encode([new[k] for k in part], is_pretokenized=True, add_special_tokens=False)
            now.store(at + np.array(part), np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(part)) if made.ids else np.zeros(len(part), np.int64))
            if self.spaces:
                now.odd[at + np.array(part)] = [new[k][:1] == " " and (len(new[k]) == 1 or new[k][1].isspace()) for k in part]
        if len(parted):
            stems, whole = stem.take(pa.array(parted)), own.take(pa.array(parted))
            marks = pa.array([w[n:] for w, n in zip(whole.to_pylist(), pc.utf8_length(stems).to_pylist(), strict=True)], pa.string())
            places = [self._places(parts) for parts in (stems, marks)]
            self._learn()
            ids, per = now.take(np.stack(places, 1).ravel())
            now.store(at + parted, ids, per[::2] + per[1::2])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Of parts of pieces, an empty one's too."""
        parts = parts.dictionary_encode()
        return self.now.pieces.places(parts.dictionary.to_numpy(zero_copy_only=False))[parts.indices.to_numpy()]

    def _marked(self, text: str) -> str | None:
        """A text that keeps white space, with its cuts marked by null characters; None if it has one itself."""
        if "\x00" in text:
            return None
        if "\n" in text and not _WIDE.search(text):
            text = text.replace("\n", "\x00\n\x00")
        return text.replace(" ", "\x00 ")  # each piece but a line's first keeps the space before it

    def _spaced(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, set[int]]:
        """Pieces of texts that keep white space, how many each text has, and the texts to be encoded as a whole."""
        marked = [self._marked(t) for t in texts]
        whole = {i for i, s in enumerate(marked) if s is None}
        lists = pc.split_pattern(pa.array([s or "" for s in marked], pa.string()), "\x00")
        del marked
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        return lists.flatten().dictionary_encode(), sizes, whole

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.now.bytes > self.cache_bytes:
            self.now, self.old = _Generation(), self.now
        pieces, sizes, whole = self._spaced(texts) if self.spaces else (*_words(texts), set())
        at = self.now.pieces.places(pieces.dictionary.to_numpy(zero_copy_only=False))[pieces.indices.to_numpy()]
        del pieces
        if self.now.pieces.new:
            self._learn()
        now = self.now
        counts = np.add.reduceat(np.append(now.count[at], 0), np.minimum(np.cumsum(sizes) - sizes, len(at))) if len(texts) else sizes
        counts = np.where(sizes > 0, counts, 0).astype(np.int64)
        if self.spaces and len(at) and now.odd[at].any():
            rows = np.repeat(np.arange(len(texts)), sizes)
            whole |= set(rows[now.odd[at]].tolist())
        ids, _ = now.take(at)
        if whole:
            ends = np.cumsum(counts)
            parts, last = [], 0
            for i in sorted(whole):
                own = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                parts += [ids[last : ends[i] - counts[i]], own]
                last = ends[i]
                counts[i] = len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces: bool, cache_bytes: int) -> Encoder:
    """One encoder in each Python worker, kept between tasks; its cache takes twice cache_bytes at most, and what one call learns."""
    key = (path, spaces, cache_bytes)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, spaces, cache_bytes)
    return _encoders[key]

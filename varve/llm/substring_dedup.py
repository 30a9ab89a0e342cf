"""Removal of repeated passages by suffix automata.

Every window of ``window`` words has an anchor: the leftmost smallest hash
among its runs of ``gram`` words. Equal windows have equal anchors, so windows
only have to meet others of their anchor. Three passes over the documents:

1. Anchors: successive windows with one anchor are one row. Rows that share an
   anchor are marked as repeated, and rows are counted by anchor.
2. Contexts: the words of the windows of each repeated anchor. They are dealt
   out by anchor; a task's anchors are its shard of the reference. Within an
   anchor contexts come in the order (doc_id, start). Each is streamed through
   the suffix automaton of those before it; wherever the matching statistic
   reaches ``window``, the window that ends there occurs earlier. A context
   equal to an earlier one is repeated as a whole. Then the automaton takes it
   in, unless it is equal to one that it has. Anchors with more than
   MOST_CONTEXTS rows, as a line or the edge of a passage that many documents
   share, get no automaton: their windows are dealt out one by one, by a hash
   of the whole window, and all but the first of a window are repeated.
3. Cut: a document's repeated windows are united, and their words removed.

What repeats within a slice of a task is settled there and sent as one row, so
a passage that very many documents share reaches its task once for a slice.
The reference grows with the corpus, so its automata are not broadcast whole:
each shard's stays in the task that built it, and only the contexts that can
match it are sent there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._scan import U, Words, grams, mix, slices
from ._tables import documents, fits, kept

_LAST = (1 << 63) - 1
#: Rows of an anchor that may meet in one automaton; each has 32 words at most at the default sizes.
MOST_CONTEXTS = 1024
#: Anchors are told apart by this many classes when those with more rows are listed; an anchor that shares such a class goes by windows too.
_CLASSES = 1 << 20


class Automaton:
    """A suffix automaton of word sequences, taken in one after another."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:  # a sequence before this one went the same way
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the shorter words that reach it by c from p."""
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def statistics(self, symbols: list[int]) -> list[int]:
        """For each place the length of the longest run that ends there and occurs in a sequence taken in."""
        nxt, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if (to := nxt[state].get(c)) is not None:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def _anchors(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the runs of successive windows with one anchor; places are of words in the slice."""
    n = len(hashes) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty
    value = grams(hashes, gram)
    place = np.arange(len(value))
    width, want = 1, window - gram + 1
    while width < want:  # leftmost minimum over want places, by doubling
        step = min(width, want - width)
        left, right = value[:-step], value[step:]
        take = right < left
        value, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        width += step
    value, place = value[:n], place[:n]
    inside = words.row[:n] == words.row[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty.astype(np.uint64), empty, empty
    new = np.ones(len(at), bool)
    new[1:] = (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    return value[first], first, np.diff(np.flatnonzero(new), append=len(at))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def mark(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """rid, start and n: runs of windows whose anchor comes more than once; start counts the document's words.

    A row with n = 0 has in rid the class of an anchor with more than MOST_CONTEXTS runs.
    """
    most = MOST_CONTEXTS
    schema = "key long, kind int, rid long, start int, n int"
    names = ["key", "kind", "rid", "start", "n"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            anchor, first, n = _anchors(words, words.hashes(), window, gram)
            if not len(anchor):
                continue
            row = words.row[first]
            rid = part.column("rid").to_numpy()[row]
            order = np.argsort(anchor, kind="stable")
            new = np.diff(anchor[order], prepend=anchor[order][:1] ^ U(1)) != 0
            here = np.zeros(len(anchor), np.int64)
            here[order] = np.repeat(np.diff(np.flatnonzero(new), append=len(order)), np.diff(np.flatnonzero(new), append=len(order)))
            lead = np.zeros(len(anchor), bool)
            lead[order] = new
            # 0: may repeat elsewhere; more: repeats here so many times, sent for those elsewhere; -1: repeats here, settled
            kind = np.where(here > 1, np.where(lead, here, -1), 0).astype(np.int32)
            key = np.where(kind < 0, mix(rid.view(np.uint64) ^ first.astype(np.uint64)), anchor)
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(kind), pa.array(rid), pa.array((first - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # a row that has met no other yet, and the last key
        total = 0  # runs of the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind, rid, start, n = (batch.column(c).to_numpy() for c in names)
            at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            runs = np.add.reduceat(np.where(kind < 0, 0, np.maximum(kind, 1)).astype(np.int64), at)
            runs[0] += total if key[0] == before else 0
            total = int(runs[-1])
            crowded = key[at][runs > most] & (_CLASSES - 1)
            if len(crowded):
                none = np.zeros(len(crowded), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(crowded), pa.array(none), pa.array(none)], names=["rid", "start", "n"])
            if held is not None:
                key, kind, rid, start, n = (np.append(h, x) for h, x in zip(held, (key, kind, rid, start, n), strict=True))
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            same[0] = held is None and before is not None and key[0] == before
            found = same[:-1] | same[1:] | (kind != 0)
            before = key[-1]
            held = None
            if not found[-1]:
                held = tuple(x[-1:] for x in (key, kind, rid, start, n))
            yield pa.RecordBatch.from_arrays([pa.array(rid[found]), pa.array(start[found]), pa.array(n[found])], names=["rid", "start", "n"])

    sent = docs.select("rid", "text").mapInArrow(send, schema)
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "rid long, start int, n int")


def compare(marked: DataFrame, window: int, gram: int, crowded: np.ndarray) -> DataFrame:
    """rid, start and n: runs of windows that occur earlier, given documents with the runs to look at in marks.

    crowded: the classes of anchors whose windows are dealt out one by one.
    """
    schema = "key long, kind int, doc long, rid long, start int, n int, symbols binary"
    names = ["key", "kind", "doc", "rid", "start", "n", "symbols"]
    extra = window - 1

    def alone(hashes: np.ndarray, anchor: np.ndarray, doc: np.ndarray, rid: np.ndarray, first: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """A row (kind 2) for each different window of these runs, its key the window's hash and its symbols the anchor; the others are settled."""
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        anchor, doc, rid = (np.repeat(x, n) for x in (anchor, doc, rid))
        first, start = np.repeat(first, n) + shift, np.repeat(start, n) + shift
        value = grams(hashes, window)[first]
        order = np.lexsort((start, rid, doc, anchor, value))
        anchor, doc, rid, first, start, value = (x[order] for x in (anchor, doc, rid, first, start, value))
        lead = np.ones(len(value), bool)
        lead[1:] = (value[1:] != value[:-1]) | (anchor[1:] != anchor[:-1])
        which = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        stay = np.flatnonzero(lead | (rid != rid[which]) | (start != start[which]))  # repeated rows go
        lead = lead[stay]
        key = np.where(lead, value[stay], mix(rid.view(np.uint64) ^ first.astype(np.uint64))[stay])
        ends = np.append(0, np.cumsum(np.where(lead, 8, 0))).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(stay), [None, pa.py_buffer(ends), pa.py_buffer(anchor[stay][lead].tobytes())])
        kind = np.where(lead, 2, 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([_signed(key), pa.array(kind), pa.array(doc[stay]), pa.array(rid[stay]), pa.array(start[stay].astype(np.int32)), pa.array(np.ones(len(stay), np.int32)), data], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            hashes = words.hashes()
            marks = part.column("marks")
            sizes = np.diff(marks.offsets.to_numpy())
            flat = marks.flatten()
            start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            if not len(start):
                continue
            row = np.repeat(np.arange(part.num_rows), sizes)
            first = words.first[row] + start
            value = grams(hashes, gram)
            anchor = value[first]
            for j in range(1, window - gram + 1):
                np.minimum(anchor, value[first + j], out=anchor)
            rid = part.column("rid").to_numpy()[row]
            doc = part.column("doc").to_numpy()[row]
            single = np.isin(anchor & U(_CLASSES - 1), crowded)
            if single.any():
                yield alone(hashes, *(x[single] for x in (anchor, doc, rid, first, start, n)))
                if single.all():
                    continue
                row, start, n, first, anchor, rid, doc = (x[~single] for x in (row, start, n, first, anchor, rid, doc))
            length = n + extra
            end = np.cumsum(length)
            inner = np.arange(int(end[-1])) - np.repeat(end - length, length)
            own = hashes[np.repeat(first, length) + inner]
            digest = np.add.reduceat(mix(own + inner.astype(np.uint64) * U(0x9E3779B97F4A7C15)), end - length) ^ anchor
            order = np.lexsort((start, rid, doc, digest))
            lead = np.ones(len(order), bool)
            lead[1:] = digest[order][1:] != digest[order][:-1]
            which = np.flatnonzero(lead)[np.cumsum(lead) - 1]  # of each the first equal context here
            kind = np.zeros(len(order), np.int32)
            twin = (rid[order] == rid[order][which]) & (start[order] == start[order][which])  # repeated rows
            kind[order] = np.where(lead, 0, np.where(twin, 2, 1))
            stay = np.flatnonzero(kind < 2)
            symbols = (own >> U(32)).astype("<u4")
            keep = np.repeat(kind == 0, length)
            ends = np.cumsum(np.where(kind == 0, length, 0)[stay]) * 4
            data = pa.Array.from_buffers(pa.binary(), len(stay), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(symbols[keep].tobytes())])
            key = np.where(kind == 0, anchor, mix(rid.view(np.uint64) ^ first.astype(np.uint64)))[stay]
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(kind[stay]), pa.array(doc[stay]), pa.array(rid[stay]), pa.array(start[stay].astype(np.int32)), pa.array(n[stay].astype(np.int32)), data], names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, waiting, automaton = None, {}, [], None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for key, kind, rid, start, n, symbols in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "rid", "start", "n", "symbols")), strict=True):
                if kind == 1:
                    out.append((rid, start, n))
                    continue
                if (key, kind) != last:
                    last, seen, waiting, automaton = (key, kind), {}, [], None
                if (first := seen.get(symbols)) is not None:
                    if first != (rid, start):
                        out.append((rid, start, n))
                    continue
                if kind == 2:
                    seen[symbols] = (rid, start)
                    continue
                if seen:  # there are earlier contexts, all different from it
                    automaton = automaton or Automaton()
                    for w in waiting:
                        automaton.add(np.frombuffer(w, "<u4").tolist())
                    waiting = []
                    begin = -1
                    for i, m in enumerate([*automaton.statistics(np.frombuffer(symbols, "<u4").tolist())[extra:], 0]):
                        if m >= window and begin < 0:
                            begin = i
                        elif m < window and begin >= 0:
                            out.append((rid, start + begin, i - begin))
                            begin = -1
                seen[symbols] = (rid, start)
                waiting.append(symbols)
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["rid", "start", "n"])

    sent = marked.select("doc", "rid", "text", "marks").mapInArrow(send, schema)
    return sent.repartition("key").sortWithinPartitions("key", "kind", "doc", "rid", "start").mapInArrow(stream, "rid long, start int, n int")


def _by_document(runs: DataFrame, name: str) -> DataFrame:
    return kept(runs.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias(name)), name)


def _marked(runs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """mark()'s runs by document, and the classes of anchors with too many rows; there are _CLASSES of these at most."""
    table = kept(runs.groupBy("rid", (F.col("n") == 0).alias("crowded")).agg(F.collect_list(F.struct("start", "n")).alias("marks")), "marks")
    classes = table.where("crowded").select("rid").toArrow().column("rid").to_numpy()
    return table.where("not crowded").select("rid", "marks"), np.sort(classes).astype(np.uint64)


def _with(docs: DataFrame, table: DataFrame, name: str, every: bool) -> DataFrame:
    """``docs`` with the runs of ``table`` by rid; ``every``: also those without, as null.

    If the list of rids fits a broadcast, texts without runs stay where they
    are and only the others are shuffled.
    """
    if not fits(table, 16):
        return docs.join(table, "rid", "left" if every else "inner")
    ids = F.broadcast(table.select("rid"))
    some = docs.join(ids, "rid", "left_semi").join(table, "rid")
    if not every:
        return some
    return some.unionByName(docs.join(ids, "rid", "left_anti").withColumn(name, F.lit(None).cast(table.schema[name].dataType)))


def cut(docs: DataFrame, schema: StructType, window: int) -> DataFrame:
    """The columns of ``schema`` with the words of the runs of windows in cuts (null: none) cut from text, and n_words and n_removed."""
    columns = schema.names
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            runs = part.column("cuts")
            sizes = np.zeros(part.num_rows, np.int64)
            valid = runs.is_valid().to_numpy(zero_copy_only=False)
            sizes[valid] = np.diff(runs.offsets.to_numpy())[valid]
            flat = runs.flatten()
            start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            first = words.first[np.repeat(np.arange(part.num_rows), sizes)] + start
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + n + window - 1, -1)
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.bincount(words.row[gone], minlength=part.num_rows)
            texts = part.column("text").to_pylist()
            for r in np.flatnonzero(removed).tolist():
                a, b = int(words.first[r]), int(words.first[r + 1])
                data = words.raw[words.offsets[r] : words.offsets[r + 1]]
                delta = np.zeros(len(data) + 1, np.int8)
                at = np.flatnonzero(gone[a:b]) + a
                # from a removed word's start to the next word's start, or to the end of the last word
                to = np.where(at + 1 < b, words.start[np.minimum(at + 1, len(words) - 1)], words.end[at])
                delta[words.start[at] - words.offsets[r]] += 1
                np.subtract.at(delta, to - words.offsets[r], 1)
                texts[r] = data[np.cumsum(delta)[:-1] == 0].tobytes().decode()
            cols = [pa.array(texts, pa.string()) if f == "text" else part.column(f) for f in columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64))], names=[*columns, "n_words", "n_removed"])

    return docs.select(*columns, "cuts").mapInArrow(run, ", ".join([*fields, "n_words long", "n_removed long"]))


def dedup(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """``docs`` (doc_id, text) with the words of repeated windows cut from text, and n_words and n_removed.

    A window of ``window`` words is repeated if it also starts earlier: in a
    document of smaller doc_id, or further ahead in the same one. Windows are
    judged on the text as given. White space before a cut stays. Null texts
    stay null, texts of fewer words than a window stay as they are, a null
    doc_id comes after all others, and rows equal in doc_id and text count as
    one document. Columns of ``docs`` named rid, doc, marks, cuts, n_words or
    n_removed are replaced.
    """
    mine = ["rid", "doc", "marks", "cuts", "n_words", "n_removed"]
    own = docs.drop(*mine)
    keyed = own.withColumn("rid", F.xxhash64("doc_id", "text"))
    marks, crowded = _marked(mark(keyed, window, gram))
    ordered = keyed.select("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    cuts = _by_document(compare(_with(ordered, marks, "marks", False), window, gram, crowded), "cuts")
    joined = _with(keyed, cuts, "cuts", True).drop("rid")
    return cut(joined, own.schema, window)


def digests(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the words that stay, joined by spaces.

    A null or empty text has no words and the digest of nothing; every row of
    ``deduped`` gives one, repeated ones too, and an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sums = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("n_words"), part.column("n_removed"), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return deduped.select("doc_id", "text", "n_words", "n_removed").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents without repeated passages. Nulls, repeats, short and long texts and empty tables: see dedup()."""
    return digests(dedup(documents(spark, sf_dir).select("doc_id", "text")))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL = {
    "op9_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM repeated
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0
), kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
}

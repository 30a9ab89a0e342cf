"""Removal of passages of a reference corpus by broadcast suffix automata.

The reference, as a set of benchmark items or licences, is read once. Its texts
are dealt into shards of at most ``shard_words`` words; a task builds a shard's
suffix automaton and writes it as sorted arrays: at most two states and three
transitions a word, so at most 68 bytes a word. Longer texts are parted with an
overlap of a window less one word, so every window lies in one shard whole.

Shards are broadcast in groups of at most ``group_bytes``. Documents stream
past a group where they lie, without a shuffle: places whose runs of ``gram``
words occur nowhere in the group are passed over by one search in a sorted
array, and the rest run through the automata side by side. Wherever the
matching statistic reaches ``window`` the window that ends there is in the
reference; their union is what the maximal spans cover. With more than one
group documents are written between groups, so a worker holds one at a time,
and the work is one pass over the documents for each group.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import Words, grams, slices
from ._tables import BROADCAST_BYTES, documents, kept
from .substring_dedup import Automaton, cut, digests

_CUTS = "array<struct<start:int,n:int>>"
_ARRAYS = ("words", "grams", "key", "to", "link", "length")


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return np.where(table[at] == x, at, -1)


class Shard:
    """A suffix automaton as sorted arrays, with the hashes of its words and of their runs of ``gram`` words."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.words, self.grams, self.key, self.to, self.link, self.length = (arrays[name] for name in _ARRAYS)

    @classmethod
    def of(cls, sequences: list[np.ndarray], gram: int) -> Shard:
        words, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
        automaton, at = Automaton(), 0
        for s in sequences:
            automaton.add(symbols[at : at + len(s)].tolist())
            at += len(s)
        key = np.fromiter((state << 32 | c for state, to in enumerate(automaton.next) for c in to), np.int64)
        to = np.fromiter((q for to in automaton.next for q in to.values()), np.int32)
        order = np.argsort(key)
        runs = np.unique(np.concatenate([grams(s, gram) for s in sequences]))
        return cls(dict(zip(_ARRAYS, (words, runs, key[order], to[order], np.array(automaton.link, np.int32), np.array(automaton.length, np.int32)), strict=True)))

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as arrays:
            return cls({name: arrays[name] for name in _ARRAYS})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in _ARRAYS})
        return out.getvalue()

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = _among(state << 32 | symbol, self.key)
        return np.where(at < 0, -1, self.to[at])

    def statistics(self, symbols: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each step t the runs still going on, and the length of their longest match that ends at their word t.

        A run is symbols[first : first + count]; runs are numbered by falling count.
        """
        state, matched = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for t in range(int(count.max(initial=0))):
            live = int(np.searchsorted(-count, -t))
            s, m, c = state[:live], matched[:live], symbols[first[:live] + t]
            to = self._step(s, c)
            lost = np.flatnonzero((to < 0) & (s > 0))
            while len(lost):
                s[lost] = self.link[s[lost]]
                m[lost] = self.length[s[lost]]
                to[lost] = self._step(s[lost], c[lost])
                lost = lost[(to[lost] < 0) & (s[lost] > 0)]
            on = to >= 0
            s[on] = to[on]
            m[on] += 1
            yield first[:live] + t, m

    def windows(self, hashes: np.ndarray, value: np.ndarray, at: np.ndarray, begin: np.ndarray, window: int, gram: int) -> None:
        """Sets ``begin`` where a window of this shard starts; value: hashes of the runs of ``gram`` words at the places ``at``."""
        at = at[_among(value, self.grams) >= 0]
        if not len(at):
            return
        edge = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
        first, count = at[edge], np.diff(edge, append=len(at)) + gram - 1
        order = np.argsort(-count, kind="stable")
        order = order[count[order] >= window]
        if not len(order):
            return
        low, high = int(first[order].min()), int((first + count)[order].max())
        symbols = _among(hashes[low:high], self.words)
        symbols[symbols < 0] = len(self.words)
        for place, m in self.statistics(symbols, first[order] - low, count[order]):
            begin[place[m >= window] + (low - window + 1)] = True


def shards(reference: DataFrame, window: int, gram: int, shard_words: int) -> DataFrame:
    """shard: the automata of the different texts of ``reference``; texts of fewer words than a window have none."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Shard.of(held, gram).dump()], pa.binary())], names=["shard"])

        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            hashes = words.hashes()
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                for at in range(a, b - window + 1, shard_words - window + 1):
                    piece = hashes[at : min(b, at + shard_words)]
                    if held and size + len(piece) > shard_words:
                        yield made()
                        held, size = [], 0
                    held.append(piece)
                    size += len(piece)
        if held:
            yield made()

    return reference.select("text").distinct().mapInArrow(build, "shard binary")


def groups(blobs: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Successive shards within ``limit`` bytes, one at least."""
    held: list[bytes] = []
    for blob in blobs:
        if held and sum(map(len, held)) + len(blob) > limit:
            yield held
            held = []
        held.append(blob)
    if held:
        yield held


def remove(docs: DataFrame, reference: DataFrame, window: int = 13, gram: int = 8, shard_words: int = 1 << 16, group_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (text) with the words of every window of ``window`` words that is in a text of ``reference`` (text) cut, and n_words and n_removed.

    Null texts stay null and null texts of the reference hold nothing; texts of
    fewer words than a window stay as they are, long ones are taken whole;
    every row of ``docs`` is judged by itself, repeated ones too; an empty
    reference removes nothing and an empty table stays empty. Columns of
    ``docs`` named cuts, n_words or n_removed are replaced; other columns may
    have any name.
    """
    if not 2 <= gram <= window <= shard_words:
        raise ValueError("2 <= gram <= window <= shard_words")
    spark = docs.sparkSession
    own = docs.drop("cuts", "n_words", "n_removed")
    columns = own.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def passed(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = [Shard.load(blob) for blob in held.value]
            every = np.unique(np.concatenate([s.grams for s in group]))
            for part in slices(batches, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                value = grams(hashes, gram)
                at = np.flatnonzero((words.row[: len(value)] == words.row[gram - 1 :]) & (_among(value, every) >= 0)) if len(value) else np.zeros(0, np.int64)
                begin = np.zeros(len(words), bool)
                old = part.column("cuts")
                counts = np.diff(old.offsets.to_numpy())
                start, n = (old.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
                for i, k in zip((words.first[np.repeat(np.arange(part.num_rows), counts)] + start).tolist(), n.tolist(), strict=True):
                    begin[i : i + k] = True
                for shard in group:
                    shard.windows(hashes, value[at], at, begin, window, gram)
                on = np.flatnonzero(begin)
                new = np.ones(len(on), bool)
                new[1:] = (np.diff(on) != 1) | (np.diff(words.row[on]) != 0)
                first = on[new]
                n = np.diff(np.flatnonzero(new), append=len(on))
                row = words.row[first]
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
                runs = pa.StructArray.from_arrays([pa.array((first - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["start", "n"])
                cuts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), cuts], names=[*columns, "cuts"])

        return run

    automata = kept(shards(reference, window, gram, shard_words), "automata")
    out = own.withColumn("cuts", F.array().cast(_CUTS))
    last = None
    for group in groups((r.shard for r in automata.toLocalIterator()), group_bytes):
        if last is not None:  # a worker holds one group at a time
            out = kept(out, "passed")
        last = spark.sparkContext.broadcast(group)
        out = out.mapInArrow(passed(last), f"{fields}, cuts {_CUTS}")
    return cut(out, own.schema, window)


def reference_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents without the passages of benchmark. Nulls, repeats, long texts and empty tables: see remove()."""
    return digests(remove(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


QUERIES = {"reference_passages": reference_passages}
SQL = {
    "reference_passages": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), reference AS (
  SELECT DISTINCT array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM b WHERE len(ws) >= 13)
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM windows SEMI JOIN reference USING (k)
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

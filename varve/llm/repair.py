"""Token-id files compressed by a Re-Pair grammar for each shard.

Documents lie in ascending doc_id order, range-partitioned, so the place of an
id in the whole corpus follows from shard totals. A row of the file table is a
shard of about 4 MB of text, of which a task writes several: little-endian arrays of the documents (doc_ids, counts of ids, counts of
symbols), the symbols, and the grammar (the pair of each rule and the number of
ids that it expands to). A symbol from ``base`` on stands for rule symbol - base,
whose pair may hold earlier rules. Symbols never cross a document's end, so a
document is decoded from its own symbols alone, and expansion lengths tell
where an id lies without expanding what comes before it.

Re-Pair works in rounds: each counts adjacent pairs exactly, gives all frequent
ones rules, and replaces their occurrences, the more frequent pair first where
two overlap, until no pair is left that is frequent and pays for its rule.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._encode import encoder
from ._scan import slices
from ._tables import documents, kept

FILE_SCHEMA = "task int, shard int, first_doc long, n_docs long, n_tokens long, base int, width int, doc_ids binary, doc_tokens binary, doc_symbols binary, symbols binary, rules binary, expansions binary"
_BUCKETS = 20


def _frequent(a: np.ndarray, b: np.ndarray, turn: int, often: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, pair of each place, pairs, counts): where pairs (a[i], b[i]) stand that occur ``often`` times or more.

    Pairs are counted by hash buckets first; those in heavy buckets exactly.
    """
    bits = min(_BUCKETS, max(10, len(a).bit_length() + 1))
    # other factors in each round, so pairs that share a bucket in one are apart in the next
    bucket = (a * np.uint32(0x9E3779B1 + 2 * turn) + b * np.uint32(0x85EBCA77 + 2 * turn)) >> np.uint32(32 - bits)
    heavy = np.flatnonzero(np.bincount(bucket, minlength=1 << bits) >= often)
    slot = np.full(1 << bits, -1, np.int32)
    slot[heavy] = np.arange(len(heavy))
    which = slot[bucket]
    at = np.flatnonzero(which >= 0)
    which = which[at]
    key = a[at].astype(np.uint64) << np.uint64(32) | b[at]
    pairs = np.zeros(len(heavy), np.uint64)
    pairs[which[::-1]] = key[::-1]  # the first pair of a bucket
    other = np.flatnonzero(pairs[which] != key)
    if len(other):  # the others of the bucket get places of their own
        more, place = np.unique(key[other], return_inverse=True)
        which[other] = len(pairs) + place
        pairs = np.concatenate([pairs, more])
    counts = np.bincount(which, minlength=len(pairs))
    good = np.flatnonzero(counts[which] >= often)
    return at[good], which[good], pairs, counts


def compress(ids: np.ndarray, counts: np.ndarray, base: int, least: int = 4, pays: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rule pairs, expansion lengths) of ids, of which each document has counts[i].

    A pair is frequent with ``least`` occurrences; a rule that would be used
    fewer than ``pays`` times is not made.
    """
    seq, n = ids.astype(np.uint32), len(ids)
    last = np.zeros(n, bool)
    last[(np.cumsum(counts) - 1)[counts > 0]] = True
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # the next and the previous place that has a symbol
    alive, flag = np.ones(n, bool), np.zeros(n + 1, bool)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    left_over = n
    turn, where = 0, np.flatnonzero(~last)
    while left_over >= 2 * least:
        at, which, pairs, weight = _frequent(seq[where], seq[after[where]], turn, least)
        at = where[at]
        turn += 1
        if not len(at):
            break
        every = at
        weight = weight[which]  # where occurrences of one pair overlap, every other one stays; else the more frequent pair's
        touch = at[1:] == after[at[:-1]]
        same = touch & (weight[1:] == weight[:-1])
        beats = np.ones(len(at), bool)
        later = np.flatnonzero(same) + 1  # in a run of overlapping places, all but its first
        begins = np.flatnonzero(np.diff(later, prepend=-1) != 1)
        beats[later[(np.arange(len(later)) - np.repeat(begins, np.diff(begins, append=len(later)))) % 2 == 0]] = False
        clash, less = touch & ~same & beats[:-1] & beats[1:], weight[:-1] < weight[1:]
        beats[:-1] &= ~(clash & less)
        beats[1:] &= ~clash | less
        won = np.flatnonzero(beats)
        at, which = at[won], which[won]
        keep = np.bincount(which, minlength=len(pairs)) >= pays
        if not keep.any():
            break
        number = np.cumsum(keep) - 1 + base + len(lengths)
        used = np.flatnonzero(keep[which])
        at, which = at[used], which[used]
        new = pairs[keep]
        left, right = (new >> np.uint64(32)).astype(np.uint32), new.astype(np.uint32)
        size = lambda s: np.where(s < base, 1, lengths[np.maximum(s.astype(np.int64) - base, 0)] if len(lengths) else 1)
        added = size(left) + size(right)
        rules.append(np.stack([left, right], 1))
        lengths = np.concatenate([lengths, added])
        gone = after[at]
        # counts of other pairs only fall, so the next round looks at pairs with a new symbol and at those found now but not replaced
        flag[at] = flag[gone] = True
        waiting = every[np.flatnonzero(~(flag[every] | flag[after[every]]))]
        flag[at] = flag[gone] = False
        seq[at] = number[which].astype(np.uint32)
        last[at] = last[gone]
        alive[gone] = False
        left_over -= len(gone)
        after[at] = after[gone]
        before[after[at]] = at
        flag[at] = flag[before[at]] = flag[waiting] = True
        flag[-1] = False  # what stands before the first place
        where = np.flatnonzero(flag)
        flag[where] = False
        where = where[np.flatnonzero(~last[where])]
    left = np.flatnonzero(alive)
    seq, last = seq[left], last[left]
    symbols = np.zeros(len(counts), np.int64)
    ends = np.flatnonzero(last) + 1
    symbols[counts > 0] = np.diff(ends, prepend=0)
    return seq, symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rules one after another, and where each begins."""
    start = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint32)
    done = 0
    while done < len(rules):  # rules whose pairs are known are filled together
        ready = int(np.argmax((rules[done:] >= base + done).any(axis=1))) if (rules[done:] >= base + done).any() else len(rules) - done
        part = rules[done : done + ready]
        out[start[done] : start[done] + lengths[done : done + ready].sum()] = expand(part.ravel(), out, start, lengths, base)
        done += ready
    return out, start


def expand(symbols: np.ndarray, ids: np.ndarray, start: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of symbols, given the expansions of the rules in them."""
    rule = symbols >= base
    size = np.ones(len(symbols), np.int64)
    r = symbols[rule].astype(np.int64) - base
    size[rule] = lengths[r]
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint32)
    out[(end - size)[~rule]] = symbols[~rule]
    n = size[rule]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat((end - size)[rule], n) + inner] = ids[np.repeat(start[r], n) + inner]
    return out


class Shard:
    """A row of the file table, to be read from any document on."""

    def __init__(self, row: dict):
        kind = "<u2" if row["width"] == 2 else "<u4"
        self.base = row["base"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
        self.per_doc = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], kind).astype(np.uint32)
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
        self.rule_ids, self.rule_start = expansions(self.rules, self.lengths, self.base)
        self.first = np.cumsum(self.per_doc) - self.per_doc

    def decode(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the shard's document i, from the symbols that cover them alone."""
        own = self.symbols[self.first[i] : self.first[i] + self.per_doc[i]]
        stop = int(self.tokens[i]) if stop is None else min(stop, int(self.tokens[i]))
        if stop <= start:
            return np.zeros(0, np.uint32)
        if (start, stop) != (0, int(self.tokens[i])):
            size = np.where(own < self.base, 1, self.lengths[np.maximum(own.astype(np.int64) - self.base, 0)] if len(self.lengths) else 1)
            end = np.cumsum(size)
            a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left")) + 1
            before = int(end[a] - size[a])
            return expand(own[a:b], self.rule_ids, self.rule_start, self.lengths, self.base)[start - before : stop - before]
        return expand(own, self.rule_ids, self.rule_start, self.lengths, self.base)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rule_ids, self.rule_start, self.lengths, self.base)


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, base: int = 49408, block_bytes: int = 4 << 20, cache_bytes: int = 48 << 20) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the file table to the shared folder; returns it as read back.

    A document is its ids, then ``end_id``; a null or empty text is its end id
    alone; a text longer than ``block_bytes`` is a shard of its own. Rows come
    in ascending doc_id order (null first); those of one doc_id go by a hash of
    the text; an empty table gives an empty one; other columns are ignored. base:
    above all ids.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", block_bytes):
            texts = [t or "" for t in part.column("text").to_pylist()]
            bare, counts = encoder(path, False, cache_bytes).encode(texts)
            tokens = counts + 1
            ids = np.full(int(tokens.sum()), end_id, np.uint32)
            ids[np.arange(len(bare)) + np.repeat(np.arange(len(texts)), counts)] = bare
            seq, symbols, rules, lengths = compress(ids, tokens, base)
            narrow = base + len(rules) <= 1 << 16
            doc_ids = part.column("doc_id").cast(pa.int64())
            row = {
                "task": task, "shard": shard, "first_doc": doc_ids[0].as_py(), "n_docs": len(texts), "n_tokens": len(ids), "base": base, "width": 2 if narrow else 4,
                "doc_ids": doc_ids.fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes(), "doc_tokens": tokens.astype("<u4").tobytes(), "doc_symbols": symbols.astype("<u4").tobytes(),
                "symbols": seq.astype("<u2" if narrow else "<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "expansions": lengths.astype("<u4").tobytes(),
            }
            shard += 1
            yield pa.RecordBatch.from_pylist([row], schema=_FILE)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return kept(ordered.mapInArrow(run, FILE_SCHEMA), "repair")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_FILE = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in FILE_SCHEMA.split(", ")])


def starts(files: DataFrame) -> DataFrame:
    """(task, shard, before): the ids of all shards before each, by totals of tasks and then within each task."""
    shards = files.select("task", "shard", "first_doc", "n_tokens")
    tasks = shards.groupBy("task").agg(F.min("first_doc").alias("low"), F.sum("n_tokens").alias("total"))
    # one row for each partition of the writer, so this window holds no more rows than there were tasks
    before = tasks.select("task", (F.sum("total").over(Window.orderBy(F.col("low").asc_nulls_first(), "task")) - F.col("total")).alias("tasks_before"))
    inner = Window.partitionBy("task").orderBy("shard")
    own = shards.select("task", "shard", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("own"))
    return own.join(before, "task").select("task", "shard", (F.col("own") + F.col("tasks_before")).alias("before"))


def read(files: DataFrame) -> DataFrame:
    """Decodes a file table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers.

    Repeated rows come back each; a null doc_id is null again; an empty table gives no row.
    """
    schema = "task int, shard int, doc_id long, own long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                own = Shard(row)
                ids = own.all().astype("<u4")
                end = np.cumsum(own.tokens)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(end.tolist(), own.tokens.tolist(), strict=True)]
                n = len(end)
                docs = pa.array(own.doc_ids, mask=own.doc_ids == -(1 << 63))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["task"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), docs, pa.array(end - own.tokens), pa.array(own.tokens), pa.array(crc, pa.int64())], names=["task", "shard", "doc_id", "own", "n_tokens", "ids_crc32"])

    rows = files.drop("first_doc", "n_docs", "n_tokens").mapInArrow(run, schema)
    return rows.join(starts(files), ["task", "shard"]).select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back. Nulls, repeats, long texts and empty tables: see write() and read()."""
    return read(write(documents(spark, sf_dir)))


def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op1_repair_files: every document, each starting where those of smaller doc_id end."""
    rows = kept(op1_repair_files(spark, sf_dir), "positions")
    first, last = rows.selectExpr("start as at"), rows.selectExpr("start + n_tokens as at")
    # each document's end is another's start, but for the last one's
    ends = last.groupBy("at").count().join(first.groupBy("at").count().withColumnRenamed("count", "starts"), "at", "full")
    gapless = ends.agg(F.expr("sum(IF(coalesce(count, 0) = coalesce(starts, 0), 0, 1)) = 2").alias("gapless"))
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.expr("min(start) = 0 and max(start + n_tokens) = sum(n_tokens)").alias("spans_all"), F.expr("min(n_tokens) >= 1").alias("ended")).join(F.broadcast(gapless))


QUERIES = {"op1_repair_files": op1_repair_files, "token_positions": token_positions}
#: Token ids are not for SQL.
SQL = {"token_positions": "SELECT CAST(count(*) AS BIGINT) AS n_docs, TRUE AS spans_all, TRUE AS ended, TRUE AS gapless FROM documents"}

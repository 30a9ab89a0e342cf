"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to whole numbers and indexed in blocks of rows. A block
keeps, for each dimension, the highest ``bits`` bits of its values above the
block's minimum as bitmaps over the rows. For a query these slices are added
with bitmap arithmetic (a slice for each bit of the query's component,
complemented where the component is negative, through carry-save adders), many
queries side by side. The k-th largest sum is read off from the most
significant slice of the result downward. The low bits that the index leaves
out bound how far a score can lie from its sum; all rows within that bound of
the k-th are the boundary, whose scores are computed exactly.

Queries are broadcast in groups of bounded size. The index stays where it is:
for each group a pass goes over its blocks, and only the k best rows of each
query and block move. Queries beyond all groups' bound make more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import kept

INDEX_SCHEMA = "block long, n int, dims int, shift int, ids binary, values binary, low binary, slices binary"
#: Components beyond this are scored without the index, in unbounded integers.
_LARGE = 1 << 26


def quantised(batch: pa.RecordBatch, scale: float = 256.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, whole numbers as float64) of the rows that take part."""
    ids, out = [], []
    for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if np.isfinite(x).all():
            ids.append(i)
            out.append(x)
    return np.array(ids, np.int64), out


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    dims = max((len(r) for r in rows), default=0)
    if all(len(r) == dims for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def index(vectors: DataFrame, bits: int = 5, rows: int = 8192, scale: float = 256.0) -> DataFrame:
    """INDEX_SCHEMA rows, a block each, of ``vectors`` (vec_id, embedding).

    Vectors that are null or hold a null or non-finite component take no part,
    nor do those without a vec_id. Repeated rows are indexed each; an empty
    table gives no block; other columns are ignored.
    """

    def block(number: int, ids: np.ndarray, x: np.ndarray) -> dict:
        n, dims = x.shape
        low = x.min(axis=0) if n else np.zeros(dims)
        row = {"block": number, "n": n, "dims": dims, "shift": -1, "ids": ids.astype("<i8").tobytes(), "values": x.astype("<f8").tobytes(), "low": low.astype("<f8").tobytes(), "slices": b""}
        if n and dims and np.abs(x).max() < _LARGE:
            above = (x - low).astype(np.int64)
            shift = max(0, int(above.max()).bit_length() - bits)
            high = (above >> shift).T
            words = -(-n // 64)
            cut = np.zeros((dims, bits, words * 64), bool)
            for s in range(bits):
                cut[:, s, :n] = high >> s & 1
            row |= {"shift": shift, "slices": np.packbits(cut, axis=2, bitorder="little").tobytes(), "values": x.astype("<i4").tobytes()}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held = TaskContext.get().partitionId() << 24, [], []
        count = 0

        def flush():
            nonlocal number, ids, held, count
            made = block(number, np.concatenate(ids), _matrix(held))
            number, ids, held, count = number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([made], schema=_INDEX)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                i, v = quantised(batch.slice(at, rows), scale)
                while len(i):
                    take = rows - count
                    ids.append(i[:take])
                    held += v[:take]
                    count += len(i[:take])
                    i, v = i[take:], v[take:]
                    if count == rows:
                        yield flush()
        if count:
            yield flush()

    return vectors.select("vec_id", "embedding").mapInArrow(run, INDEX_SCHEMA)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_INDEX = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in INDEX_SCHEMA.split(", ")])


def sums(slices: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Slices, lowest first, of sum_j |q_j| u_j for each query and row; u_j are the slices' values, or their complements where q_j is negative.

    Bitmaps are made when their weight's turn comes, and three of a weight at
    once become one of it and a carry, so few are held at a time.
    """
    dims, bits, words = slices.shape
    size, sign = np.abs(q), np.where(q < 0, np.uint64(2**64 - 1), np.uint64(0))
    todo: dict[int, list[tuple]] = {}
    for t in range(int(size.max()).bit_length() if size.size else 0):
        on = np.where(size >> t & 1, np.uint64(2**64 - 1), np.uint64(0))
        for j in np.flatnonzero(on.any(axis=0)):
            for s in range(bits):
                todo.setdefault(t + s, []).append((j, s, on[:, j]))
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    while todo or carries:
        held: list[np.ndarray] = []
        after: list[np.ndarray] = []
        made = ((slices[j, s][None, :] ^ sign[:, j][:, None]) & on[:, None] for j, s, on in todo.pop(len(out), []))
        for c in chain(carries, made):
            if len(held) < 2:
                held.append(c)
                continue
            a, b = held
            x = a ^ b
            held = [x ^ c]
            after.append(a & b | x & c)
        if len(held) == 2:
            a, b = held
            held = [a ^ b]
            after.append(a & b)
        out.append(held[0] if held else np.zeros((len(q), words), np.uint64))
        carries = after
    return out


def boundary(slices: list[np.ndarray], valid: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is at least the k-th largest, from the top slice downward, less each query's slack.

    valid: the bitmap of the rows that count, one for all queries or one for each.
    """
    queries = slices[0].shape[0] if slices else len(slack)
    inside = np.zeros((queries, 1), np.int64)
    equal = np.broadcast_to(valid, (queries, valid.shape[-1])).copy()
    kth = np.zeros(queries, np.int64)
    for w in range(len(slices) - 1, -1, -1):
        both = equal & slices[w]
        count = np.bitwise_count(both).sum(axis=1, keepdims=True, dtype=np.int64)
        up = inside + count >= k
        kth |= up[:, 0].astype(np.int64) << w
        inside = np.where(up, inside, inside + count)
        equal = np.where(up, both, equal & ~slices[w])
    floor = np.maximum(kth - slack, 0)
    above = np.zeros_like(equal)
    equal = np.broadcast_to(valid, equal.shape).copy()
    for w in range(len(slices) - 1, -1, -1):
        both = equal & slices[w]
        on = (floor >> w & 1)[:, None] > 0
        above = np.where(on, above, above | both)
        equal = np.where(on, both, equal & ~slices[w])
    return above | equal


def top(block: dict, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, vec_id, score) arrays: each query's k best rows of a block, other than its own."""
    n, dims = block["n"], block["dims"]
    ids = np.frombuffer(block["ids"], "<i8")
    if q.shape[1] != dims:  # components that one side lacks are zero
        q = np.pad(q, ((0, 0), (0, max(0, dims - q.shape[1]))))[:, :dims]
    if block["shift"] < 0 or (q.size and np.abs(q).max() >= _LARGE):
        values = np.frombuffer(block["values"], "<f8" if block["shift"] < 0 else "<i4").reshape(n, dims)
        exact = np.array([[int(v) for v in row] for row in values], object).reshape(n, dims)
        out = []
        for i, own in zip(query_ids, q, strict=True):
            score = exact @ np.array([int(v) for v in own], object) if dims else np.zeros(n, object)
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], np.int64)
            out.append(_best(np.full(n, i), ids, score, k))
        return out
    values = np.frombuffer(block["values"], "<i4").reshape(n, dims).astype(np.int64)
    words = -(-n // 64)
    slices = np.frombuffer(block["slices"], "<u8").reshape(dims, -1, words)
    whole = q.astype(np.int64)
    out = []
    side = max(1, 4096 // words)
    for at in range(0, len(whole), side):
        part = whole[at : at + side]
        slack = np.abs(part).sum(axis=1) * ((1 << block["shift"]) - 1) >> block["shift"]
        other = np.zeros((len(part), words * 64), bool)  # a query's own rows, however many, take none of its k places
        other[:, :n] = query_ids[at : at + side, None] != ids
        valid = np.packbits(other, axis=1, bitorder="little").view("<u8")
        found = boundary(sums(slices, part) or [np.zeros((len(part), words), np.uint64)], valid, k, slack + 1)
        rows = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :n]
        which, row = np.nonzero(rows)
        for b in range(0, len(which), 1 << 17):
            w, r = which[b : b + (1 << 17)], row[b : b + (1 << 17)]
            out.append(_best(query_ids[at : at + side][w], ids[r], np.einsum("ij,ij->i", part[w], values[r]), k))
    return out


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    other = query != ids
    query, ids, score = query[other], ids[other], score[other]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
    return query[rank < k], ids[rank < k], score[rank < k]


def search(blocks: DataFrame, queries: DataFrame, k: int = 5, group_bytes: int = 32 << 20, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each of ``queries`` (vec_id, embedding), ties to the smaller vec_id.

    A row does not match itself (the same vec_id). Of repeated query ids the
    smallest vector is the query; repeated rows in the index each take part.
    Vectors of other lengths end in zeros. Scores beyond a long are held at its
    ends. Without queries or rows there is no result; other columns are
    ignored. blocks: of index(), best a kept table. ``group_bytes`` bounds the
    queries that are broadcast at once.
    """
    spark = blocks.sparkSession
    asked = queries.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    asked = kept(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    count, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    groups = max(1, -(-count * (8 * (longest or 0) + 8) // group_bytes))
    schema = "query_id long, vec_id long, score long"
    names = blocks.columns

    def one_pass(which: int) -> DataFrame:
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == which).toArrow().combine_chunks()
        ids, rows = quantised(table.to_batches()[0], scale) if table.num_rows else (np.zeros(0, np.int64), [])
        sent = spark.sparkContext.broadcast((ids, _matrix(rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                for i in range(batch.num_rows if len(ids) else 0):
                    found = top({c: batch.column(c)[i].as_py() for c in names}, ids, q, k)
                    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])

        # a block is a lot of work and few bytes, so blocks are dealt out one by one
        return blocks.repartition(max(1, number)).mapInArrow(run, schema)

    number = min(blocks.count(), 4096)
    pairs = one_pass(0)
    for which in range(1, groups):
        pairs = pairs.union(one_pass(which))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose vec_id is divisible by 50. Nulls, repeats and empty tables: see search()."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(kept(index(vectors), "bsi"), vectors.where("vec_id % 50 = 0"))


SQL = {
    "op2_bit_slices": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
QUERIES = {"op2_bit_slices": op2_bit_slices}

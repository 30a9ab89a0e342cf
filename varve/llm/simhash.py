"""SimHash near duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Each of its bits has a vector of radius + 1 bits
that isn't zero; for every v but zero there is a table, whose mask has the bits
whose vector has an odd product with v. Of two fingerprints that differ in at
most ``radius`` bits, those bits' vectors span at most ``radius`` dimensions,
so some v is orthogonal to all of them, and the pair is in one bucket of that
table: no pair is lost, whatever the data.

Equal fingerprints are one class from the start. A bucket of two is settled by
its least and greatest member, in the aggregation that counts buckets. A larger
one goes to a task, which links its members by a forest and never lists pairs;
one above ``most`` is not sent anywhere but covered again by other masks, till
what the masks leave open bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scan import SPACE, Words, slices
from ._tables import documents, dropped, kept, small_side
from .components import components

BITS = 64
#: Shingles that are hashed at once.
_AT_ONCE = 1 << 16
#: A bucket whose masks leave so many bits open has at most 2 ** OPEN members, and always goes to one task.
OPEN = 16
_SIGN = -(1 << 63)


def covering_masks(radius: int, round_: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any ``radius`` bits are all outside one of them. Rounds differ in which bit has which vector."""
    many = (1 << (radius + 1)) - 1
    vectors = np.random.default_rng(1000 + round_).permutation(np.arange(BITS) % many + 1).tolist()
    return [sum(1 << bit for bit, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, many + 1)]


def fingerprints(column: pa.Array, k: int) -> np.ndarray:
    """The fingerprint of each text of a column, as signed longs; 0 for a null or wordless text."""
    words = Words(column, lower=True)
    rows = len(column)
    # the words with one space between them
    keep = ~SPACE[words.raw]
    keep[words.end[words.end < len(keep)]] = True
    place = np.cumsum(keep)
    joined = words.raw[keep]
    joined[SPACE[joined]] = 0x20
    start, end, text = place[words.start] - 1, place[words.end - 1], joined.tobytes()
    many = np.where(words.counts > 0, np.maximum(words.counts - k + 1, 1), 0)
    before = np.append(0, np.cumsum(many))
    counts = np.zeros((rows, BITS), np.int64)
    for low in range(0, int(before[-1]), _AT_ONCE):
        n = np.arange(low, min(low + _AT_ONCE, int(before[-1])))
        row = np.searchsorted(before, n, "right") - 1
        first = words.first[row] + n - before[row]
        last = first + np.minimum(words.counts[row], k) - 1
        parts = map(text.__getitem__, map(slice, start[first].tolist(), end[last].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), ">u8", len(n))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        runs = np.flatnonzero(np.diff(row, prepend=-1))
        counts[row[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > many[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what fingerprints within ``radius`` of each other connect; each one found is looked for no more."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                queue += found
                a += [at] * len(found)
                b += found
    return a, b


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, rep = (batch.column(c).to_numpy() for c in ("key", "fp", "rep"))
            if held is not None:
                key, fp, rep = (np.append(h, x) for h, x in zip(held, (key, fp, rep), strict=True))
            cut = np.flatnonzero(np.diff(key)) + 1
            edges = np.concatenate([[0], cut])
            held = tuple(x[edges[-1] :] for x in (key, fp, rep))
            yield links(fp, rep, edges)
        if held is not None:
            yield links(held[1], held[2], np.array([0, len(held[0])]))

    def links(fp: np.ndarray, rep: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for x, y in zip(edges, edges[1:], strict=False):
            i, j = forest(fp[x:y].view(np.uint64), radius)
            a.append(rep[x:y][i])
            b.append(rep[x:y][j])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    return run


def links(classes: DataFrame, radius: int, most: int = 4096) -> DataFrame:
    """(a, b): classes (fp, rep) that fingerprints of at most ``radius`` differing bits link, as many as connect them all."""
    found, now, taken, level = [], classes.select("fp", "rep", F.lit(0).cast("long").alias("key")), {0}, 0
    while True:
        masks = covering_masks(radius, level)
        taken = {t | m for t in taken for m in masks}
        last = max(BITS - t.bit_count() for t in taken) <= OPEN
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys = F.array(*[F.xxhash64("key", F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(signed)])
        entries = now.select("fp", "rep", F.explode(keys).alias("key"))
        member = F.struct("fp", "rep")
        buckets = kept(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("x"), F.max(member).alias("y")).where("n > 1"), "buckets")
        two = buckets.where("n = 2").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
        found.append(two.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
        some = buckets.where("n > 2" if last else f"n between 3 and {most}").select("key")
        found.append(entries.join(small_side(some, "8"), "key").repartition("key").sortWithinPartitions("key").mapInArrow(_forests(radius), "a long, b long"))
        hot = buckets.where(f"n > {most}").select("key")
        if last or not hot.limit(1).count():
            break
        now, level = kept(entries.join(small_side(hot, "8"), "key"), "hot"), level + 1
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of ``docs`` (doc_id, text).

    The fingerprint is the majority of each bit over the XXH64 (seed 42) of all
    shingles of ``words`` words, repeats included; a text of fewer words is one
    shingle, and null, empty and wordless texts have 0, which links like any
    other; a text of any length is one fingerprint. Equal fingerprints link.
    Rows with one doc_id are one document, with the smallest of their
    fingerprints; each row without a doc_id comes back with its fingerprint and
    no component. An empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fingerprints(part.column("text"), words))], names=["id", "fp"])

    every = kept(docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, fp long"), "fingerprints")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    nameless = every.where("id is null").select(F.col("id").alias("doc_id"), digits("fp").alias("fingerprint"), F.lit(None).cast("long").alias("component_id"))
    named = every.where("id is not null").groupBy("id").agg(F.min(F.col("fp").bitwiseXOR(F.lit(_SIGN))).bitwiseXOR(F.lit(_SIGN)).alias("fp"))
    classes = kept(named.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    roots = components(links(classes, radius)).where("id <> root").select(F.col("id").alias("rep"), "root")
    settled = kept(classes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "settled")
    dropped(classes)
    return named.join(small_side(settled, "16"), "fp").select(F.col("id").alias("doc_id"), digits("fp").alias("fingerprint"), "component_id").union(nameless)


def op11_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents. Nulls, repeats and empty tables: see near_duplicates()."""
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op11_simhash_covering": op11_simhash_covering}
#: XXH64 is beyond SQL; tests hold the query against all pairs.
SQL: dict[str, str] = {}

"""K-d tree partitioning of documents into shards of near equal bytes.

A node that is to hold m leaves is split where m // 2 leaves' share of its
bytes lies, along the dimension in which it is widest (its extent over the
root's). Rows are ordered by that dimension, then by a hash of the text, then
by a hash of the row, so rows of equal text stand together. The cut, a weighted
quantile, is found by histograms: every pass sums the bytes of all nodes of a
level by one digit of the order, and narrows each cut to a bucket. A cut moves
to the nearer edge of its bucket once that weighs less than ``tolerance`` of a
shard. If the bucket is one text, its rows stay together up to ``whole`` of a
shard, which bounds how far a shard can lie off; only heavier groups are parted.

Each level writes the rows' nodes and drops the table before, so no plan grows
with the depth, and joins the rows with a table of one row a node. The driver
sees MOST_SUMS sums a pass at most: with more nodes the digits are shorter.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import documents, dropped, kept

#: Bits of the three parts of the order: the dimension, the text's hash, the row's.
BITS = {"v": 24, "h": 60, "d": 36}
_PARTS = tuple(BITS)
MOST_SUMS = 1 << 17


def _meta(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc and the order's parts; both dimensions are functions of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
        F.char_length(text).alias("chars"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << BITS["h"]) - 1)).alias("h"),
        # the table is written before it is used, so the rows' numbers stay; they part repeated rows of one doc_id
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << BITS["d"]) - 1)).alias("d"),
    )
    top = (1 << BITS["v"]) - 1
    length = F.least(F.floor(F.log2(F.col("size").cast("double")) * F.lit(float(1 << 18))), F.lit(top)).cast("long")
    width = F.floor(F.col("chars") / F.col("size") * F.lit(float(top))).cast("long")  # code points a byte
    return base.select("doc_id", "size", "crc", "h", "d", length.alias("v0"), width.alias("v1"), F.lit(1).cast("long").alias("node"))


class Cut:
    """Where a node is cut, as far as it is known: values of v, h and d, and the lowest known bit of each."""

    def __init__(self, dim: int, before: float):
        self.dim, self.before = dim, before  # the dimension, and the bytes still to lie before the cut
        self.value = dict.fromkeys(_PARTS, 0)
        self.shift = dict.fromkeys(_PARTS, 63)
        self.part, self.done = "v", False

    def next_digit(self, bits: int) -> int:
        """The lowest bit of the next digit."""
        return max(0, min(self.shift[self.part], BITS[self.part]) - bits)

    def narrow(self, buckets: list[tuple], shift: int, light: float, whole: float) -> None:
        """Goes on to the bucket (digit, bytes, v, h, one text) that the cut lies in."""
        for k, (digit, weight, v, h, one) in enumerate(buckets):
            if weight <= self.before and k < len(buckets) - 1:
                self.before -= weight
                continue
            one = one and self.part != "d"
            self.value[self.part] += digit << shift
            self.shift[self.part] = shift
            if one:
                self.value |= {"v": v, "h": h}
                self.shift |= {"v": 0, "h": 0}
            if weight <= light or one and weight <= whole or self.part == "d" and shift == 0:
                last = "h" if one else self.part
                self.value[last] += (2 * self.before >= weight) << self.shift[last]
                self.done = True
            elif one:
                self.part = "d"
            elif shift == 0:
                self.part = _PARTS[_PARTS.index(self.part) + 1]
            return


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table, to be broadcast: a row for each node of a level."""
    text = json.dumps(rows).replace("'", "")
    return F.broadcast(spark.sql(f"SELECT inline(from_json('{text}', 'array<struct<{schema}>>'))"))


_NODE = "node:bigint,dim:int,cut_v:bigint,cut_h:bigint,cut_d:bigint"


def _node(n: int, cut: Cut) -> dict:
    return {"node": n, "dim": cut.dim} | {f"cut_{p}": cut.value[p] for p in _PARTS}


def _find(meta: DataFrame, cuts: dict[int, Cut], light: float, whole: float) -> None:
    """Passes over the rows until every cut is known."""
    while todo := {n: c for n, c in cuts.items() if not c.done}:
        bits = max(1, min(12, (MOST_SUMS // len(todo)).bit_length() - 1))
        shift = {n: c.next_digit(bits) for n, c in todo.items()}
        params = [_node(n, c) | {"part": c.part, "digit": shift[n]} | {f"known_{p}": c.shift[p] for p in _PARTS} for n, c in todo.items()]
        rows = meta.join(_rows(meta.sparkSession, params, _NODE + ",part:string,digit:int,known_v:int,known_h:int,known_d:int"), "node").withColumn("v", F.expr("IF(dim = 0, v0, v1)"))
        inside = rows.where(" and ".join(f"shiftright({p}, known_{p}) = shiftright(cut_{p}, known_{p})" for p in _PARTS))
        digit = F.expr("CASE part WHEN 'v' THEN shiftright(v, digit) - shiftright(cut_v, digit) WHEN 'h' THEN shiftright(h, digit) - shiftright(cut_h, digit) ELSE shiftright(d, digit) - shiftright(cut_d, digit) END")
        sums = inside.groupBy("node", digit.alias("at")).agg(F.sum("size").alias("bytes"), F.min("v").alias("v"), F.min("h").alias("h"), F.expr("min(v) = max(v) and min(h) = max(h)").alias("one"))
        found: dict[int, list[tuple]] = {}
        for r in sums.collect():
            found.setdefault(r["node"], []).append((r["at"], r["bytes"], r["v"], r["h"], r["one"]))
        for n, buckets in found.items():
            todo[n].narrow(sorted(buckets), shift[n], light, whole)


def _descend(meta: DataFrame, cuts: dict[int, Cut]) -> DataFrame:
    """Moves the rows of the nodes that are cut to their children, 2 n before the cut and 2 n + 1 from it on."""
    joined = meta.join(_rows(meta.sparkSession, [_node(n, c) for n, c in cuts.items()], _NODE), "node", "left").withColumn("v", F.expr("IF(dim = 0, v0, v1)"))
    before = "(v < cut_v or v = cut_v and (h < cut_h or h = cut_h and d < cut_d))"
    return joined.withColumn("node", F.expr(f"IF(dim IS NULL, node, node * 2 + IF({before}, 0, 1))")).select(*meta.columns)


def tree(meta: DataFrame, shards: int, tolerance: float = 0.002, whole: float = 0.08) -> tuple[DataFrame, dict[int, int]]:
    """meta with each row's leaf as node, and the shard of each leaf."""
    level, shard, extent, total = {1: shards}, {1: 0}, None, 0  # leaves that each node is to hold
    while level := {n: m for n, m in level.items() if m > 1}:
        found = [r for r in meta.groupBy("node").agg(F.sum("size").alias("total"), *(f(v).alias(f"{v}{n}") for v in ("v0", "v1") for n, f in (("low", F.min), ("high", F.max)))).collect() if r["node"] in level]
        if not found:
            break
        span = lambda r, k: r[f"v{k}high"] - r[f"v{k}low"]
        if extent is None:
            extent, total = [max(1, span(found[0], k)) for k in (0, 1)], found[0]["total"]
        cuts = {r["node"]: Cut(max((0, 1), key=lambda k, r=r: span(r, k) / extent[k]), r["total"] * (level[r["node"]] // 2) / level[r["node"]]) for r in found}
        _find(meta, cuts, tolerance * total / shards, whole * total / shards)
        before, meta = meta, kept(_descend(meta, cuts), "kd")
        dropped(before)
        below = {}
        for n in cuts:
            half = level[n] // 2
            below |= {2 * n: half, 2 * n + 1: level[n] - half}
            shard |= {2 * n: shard[n], 2 * n + 1: shard[n] + half}
        level = below
    return meta, shard


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, parts: int = 256, whole: float = 0.08) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of ``docs`` (doc_id, text).

    ``target_bytes`` instead of ``shards``: as many shards as it takes. Rows of
    equal text share a shard unless they weigh more than ``whole`` of one. A
    null text counts as empty; a null doc_id is placed as any other; repeated
    rows each get a slot. A text longer than a shard makes that shard as large.
    An empty table gives no row; other columns are ignored. Slots are numbered
    in ``parts`` parts of a shard, by the rows' hashes, so no task orders a
    whole shard.
    """
    meta = kept(_meta(docs), "kd")
    if shards is None:
        shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 1) // target_bytes))
    placed, shard = tree(meta, shards, whole=whole)
    numbers = _rows(docs.sparkSession, [{"node": n, "shard": i} for n, i in shard.items()], "node:bigint,shard:int")
    rows = placed.join(numbers, "node").select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("d") % parts).cast("int").alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    # shards * parts rows at most
    return numbered.join(F.broadcast(before), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes. Nulls, repeats and empty tables: see kd_shards()."""
    return kd_shards(documents(spark, sf_dir))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op6_kd_shards: rows and bytes in all, shards within a tenth and one row of their mean, slots without gaps, light groups of equal texts whole."""
    rows = kept(op6_kd_shards(spark, sf_dir), "balance")
    per = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("longest"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    even = per.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_shards"), F.expr("bool_and(low = 0 and high = n - 1)").alias("gapless"), F.expr("max(bytes) <= 1.1 * avg(bytes) + max(longest)").alias("balanced"))
    groups = rows.groupBy("text_crc32", "size").agg(F.sum("size").alias("group_bytes"), F.expr("max(shard) = min(shard)").alias("one"))
    total = F.broadcast(rows.agg(F.sum("size").alias("all_bytes")))
    whole = groups.join(total).agg(F.expr("bool_and(one or group_bytes > 0.08 * all_bytes / 40)").alias("groups_whole"))
    return even.join(F.broadcast(whole))


QUERIES = {"op6_kd_shards": op6_kd_shards, "shard_balance": shard_balance}
#: The columns of op6_kd_shards need crc32, which SQL lacks.
SQL = {
    "shard_balance": """
WITH s AS (SELECT octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(size) AS BIGINT) AS bytes, CAST(40 AS BIGINT) AS n_shards, TRUE AS gapless, TRUE AS balanced, TRUE AS groups_whole FROM s
"""
}

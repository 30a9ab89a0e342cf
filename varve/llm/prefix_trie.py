"""Conversation prefix trie by fixed-length block hashing.

A turn is a digest of its role and text, and a prefix the XOR of hashes of its
turns' digests with their depths, so prefixes come from running totals.
Conversations are cut into blocks of several turns and grouped by the digests
before and after each block: one row for each different block below each
different prefix, with the number of its conversations and the smallest.

Where one block alone follows a prefix, all its turns are nodes of the same
conversations, and are written down as they are. Turn boundaries are grouped
only where several blocks follow the same prefix, and there only the different
blocks, not the conversations.

A node is named by its smallest member and its depth. So the nodes of one
conversation are a chain, a run of depths, hung up below a node of another
chain. Totals of subtrees go up the tree of chains by pointer doubling, then
along each chain by a running total. No step needs a conversation, or the
children or the members of a node, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import dropped, kept, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: Conversation ids that one row carries to where the digest of a node's ends is made.
IDS_AT_ONCE = 4096


def running(df: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``df``, a table from kept(), with c_run for each c of sums and xors: the total within the group up to the row, in order.

    Rows are dealt out by ranges of group and order, so a large group lies in
    several parts; each part is summed on its own, and what a group's earlier
    parts hold, a row for each part at most, is added.
    """
    of = {c: f for names, f in ((sums, F.sum), (xors, F.bit_xor)) for c in names}
    placed = kept(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = placed.groupBy(group, "_part").agg(*[f(c).alias(c) for c, f in of.items()])
    several = per.groupBy(group).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(group)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.join(several, group).select(group, "_part", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c, f in of.items()])
    joined = placed.select("*", *[f(c).over(inside).alias(f"{c}_run") for c, f in of.items()]).join(F.broadcast(before), [group, "_part"], "left")  # two rows for each part at most
    total = {f"{c}_run": (F.col(f"{c}_run") + F.coalesce(f"{c}_before", F.lit(0))) if c in sums else F.col(f"{c}_run").bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0))) for c in of}
    return joined.withColumns(total).drop("_part", *[f"{c}_before" for c in of])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, words and one of each row with a conv_id; null roles and texts are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.select("*", F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, words, total) of the rebuilt conversations' turns, and (conv_id, total) of all of them."""
    placed = kept(running(kept(turns(conversations), "turns"), "conv_id", ["turn", "role", "digest", "row"], sums=("one",)).select("conv_id", F.col("one_run").alias("pos"), "digest", "words"), "positions")
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("own"))
    own = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    lead = F.least("h", F.coalesce("base_turns", F.lit(0).cast("long")))
    heads = kept(own.join(base, "base", "left").select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("total")), "heads")
    first = heads.where("lead > 0").join(placed.where("pos <= 3").withColumnRenamed("conv_id", "base"), "base").where("pos <= lead").select("conv_id", F.col("pos").alias("d"), "digest", "words", "total")
    rest = placed.join(small_side(heads, "40").select("conv_id", "h", "lead", "total"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("d"), "digest", "words", "total")
    return kept(first.union(rest), "rebuilt"), heads.select("conv_id", "total")


def _spread(edges: DataFrame) -> DataFrame:
    """d, x1, x2, y1, y2, words, conv, n: the turns of blocks with the digests of the prefixes that they end (x) and extend (y)."""
    upto = F.slice("turns", 1, F.col("i") + 1)
    total = lambda p, h: F.aggregate(upto, F.col(p), lambda acc, t: acc.bitwiseXOR(t[h]))
    rows = edges.select("*", F.posexplode("turns").alias("i", "t")).select(F.col("t.d").alias("d"), total("p1", "h1").alias("x1"), total("p2", "h2").alias("x2"), "t", "conv", "n")
    return rows.select("d", "x1", "x2", F.col("x1").bitwiseXOR(F.col("t.h1")).alias("y1"), F.col("x2").bitwiseXOR(F.col("t.h2")).alias("y2"), F.col("t.words").alias("words"), "conv", "n")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, ends_sha256) from a row for each conversation (conv_id, d, x1, x2): SHA-256 of the ids, ascending, with commas.

    The digest is sequential, so a node's ids meet in one task; they come there
    in order, joined to strings of IDS_AT_ONCE ids, and are not held.
    """
    key = ["d", "x1", "x2"]
    per = kept(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.min("conv_id").alias("least")), "ends")
    alone = per.where("k = 1").select(*key, F.sha2(F.col("least").cast("string"), 256).alias("ends_sha256"))
    some = kept(ends.join(small_side(per.where("k > 1"), "40").select(*key), key), "shared_ends")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"d": [last[0]], "x1": [last[1]], "x2": [last[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema)

        schema = pa.schema([*((c, pa.int64()) for c in (*key, "first")), ("ids", pa.string())])
        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if ids and (node != last or len(ids) == IDS_AT_ONCE):
                    yield row()
                    ids = []
                last = node
                ids.append(conv)
        if ids:
            yield row()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        schema = pa.schema([*((c, pa.int64()) for c in key), ("ends_sha256", pa.string())])
        row = lambda: pa.RecordBatch.from_pydict({"d": [last[0]], "x1": [last[1]], "x2": [last[2]], "ends_sha256": [state.hexdigest()]}, schema)
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    yield row()
                last, state = node, hashlib.sha256(ids.encode())
        if state:
            yield row()

    strings = some.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(joined, "d long, x1 long, x2 long, first long, ids string")
    shared = kept(strings, "id_strings").repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digested, "d long, x1 long, x2 long, ends_sha256 string")
    return alone.union(shared)


def _totals(chains: DataFrame) -> DataFrame:
    """(conv, leaves, saved) of each chain with all chains below it, from chains (conv, parent, leaves, saved).

    By pointer doubling: after k rounds a chain has the totals of those less
    than 2^k below, and points to the one 2^k above.
    """
    now = kept(chains.select("conv", "leaves", "saved", F.col("parent").alias("jump")), "totals")
    while now.where("jump is not null").limit(1).count():
        added = now.where("jump is not null").groupBy(F.col("jump").alias("conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        ahead = now.where("jump is not null").select(F.col("conv").alias("jump"), F.col("jump").alias("next"))  # what points to the top stops there
        sums = now.join(added, "conv", "left").join(ahead, "jump", "left")
        new = kept(sums.select("conv", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("next").alias("jump")), "totals")
        dropped(now)
        now = new
    return now.select("conv", "leaves", "saved")


def trie(conversations: DataFrame, block_turns: int = 4) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text), rebuilt; block_turns changes no result.

    Rows without a conv_id take no part. A null turn comes first; rows of one
    turn go by role, then by a digest of the text; repeated rows are turns each.
    Null roles and texts are empty, and texts of any length are one turn. An
    empty table gives no row; other columns are ignored.
    """
    each, convs = rebuilt(conversations)
    hashed = each.select("conv_id", "d", "words", "total", F.xxhash64("d", "digest").alias("h1"), F.xxhash64(F.lit("second"), "digest", "d").alias("h2"), F.floor((F.col("d") - 1) / block_turns).alias("block"))
    cut = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.max("d").alias("last"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("d", "h1", "h2", "words"))).alias("turns"))  # block_turns of them
    blocks = kept(running(kept(cut, "cut"), "conv_id", ["block"], xors=("x1", "x2")), "blocks")
    below = blocks.select("conv_id", "block", "turns", F.col("x1_run").bitwiseXOR(F.col("x1")).alias("p1"), F.col("x2_run").bitwiseXOR(F.col("x2")).alias("p2"), F.col("x1_run").alias("q1"), F.col("x2_run").alias("q2"))
    edges = kept(below.groupBy("block", "p1", "p2", "q1", "q2").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.any_value("turns").alias("turns")), "edges")
    prefix = ["block", "p1", "p2"]
    diverging = kept(edges.groupBy(*prefix).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*prefix), "diverging")
    side = small_side(diverging, "24")
    same = _spread(edges.join(side, prefix, "left_anti"))
    refined = _spread(edges.join(side, prefix, "left_semi")).groupBy("d", "x1", "x2").agg(F.any_value("y1").alias("y1"), F.any_value("y2").alias("y2"), F.any_value("words").alias("words"), F.min("conv").alias("conv"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(zero.alias("d"), zero.alias("x1"), zero.alias("x2"), zero.alias("y1"), zero.alias("y2"), zero.alias("words"), "conv", "n")
    nodes = kept(same.unionByName(refined).unionByName(top), "nodes")

    start = F.min_by(F.struct("y1", "y2"), "d")
    spans = kept(nodes.groupBy("conv").agg(F.min("d").alias("s"), F.max("d").alias("e"), start.alias("y"), F.sum((F.col("n") - 1) * F.col("words")).alias("saved")), "spans")
    root = top.select(F.col("conv").alias("parent"))
    hung = spans.where("s > 1").select("conv", F.col("s").alias("s"), (F.col("s") - 1).alias("d"), F.col("y.y1").alias("x1"), F.col("y.y2").alias("x2")).join(nodes.select("d", "x1", "x2", F.col("conv").alias("parent")), ["d", "x1", "x2"]).select("conv", "s", "parent")
    parents = kept(hung.union(spans.where("s = 1").select("conv", "s").join(F.broadcast(root))), "parents")  # one row
    counts = parents.groupBy(F.col("parent").alias("conv"), (F.col("s") - 1).alias("d")).agg(F.count(F.lit(1)).alias("k"))
    ending = counts.select("conv", F.col("d").alias("e"), "k")
    own = spans.join(ending, ["conv", "e"], "left").join(parents.select("conv", "parent"), "conv", "left").select("conv", "parent", F.col("k").isNull().cast("long").alias("leaves"), "saved")
    totals = _totals(own)
    above = parents.join(totals, "conv").groupBy(F.col("parent").alias("conv"), (F.col("s") - 1).alias("d")).agg(F.count(F.lit(1)).alias("k"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    span = spans.select("conv", "s", "e").join(parents.select("conv", "parent"), "conv", "left")
    marked = nodes.join(small_side(kept(span, "span"), "40"), "conv").join(above, ["conv", "d"], "left")
    going_on = (F.col("d") < F.col("e")).cast("long")
    children = F.coalesce("k", zero) + going_on
    values = kept(marked.select(
        "conv", "d", "x1", "x2", "n", F.when(F.col("d") > F.col("s"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), children.alias("n_children"), (-F.col("d")).alias("up"),
        (F.coalesce("leaves", zero) + (children == 0).cast("long")).alias("n_leaves"), (F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
    ), "values")
    summed = running(values, "conv", ["up"], sums=("n_leaves", "saved_tokens"))
    none = F.sha2(F.lit(""), 256)
    ended = blocks.where("last = total").select("conv_id", F.col("total").alias("d"), F.col("x1_run").alias("x1"), F.col("x2_run").alias("x2")).union(convs.where("total = 0").select("conv_id", zero, zero, zero))
    out = summed.join(_ends_digests(ended), ["d", "x1", "x2"], "left")
    long = lambda c: F.col(c).cast("long") if isinstance(c, str) else c
    names: dict[str, str | Column] = {"conv_id": "conv", "depth": "d", "parent_conv_id": "parent_conv_id", "n_convs": "n", "n_children": "n_children", "n_leaves": "n_leaves_run", "saved_tokens": "saved_tokens_run"}
    return out.select(*[long(c).alias(k) for k, c in names.items()], F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations. Nulls, repeats and empty tables: see trie()."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), table_ AS (
  SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS crcs FROM range(256) AS g(n)
), h AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s >> 8, crcs[1 + xor(s, b) % 256])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM o), table_
), u AS (
  SELECT h.c, o.r, o.t, o.i, 0 AS own FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.i <= h.h
  UNION ALL SELECT h.c, o.r, o.t, o.i, 1 FROM h JOIN o ON o.c = h.c AND o.i > h.h
), v AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, md5(length(r) || ':' || r || t) AS m, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM u
), p AS (
  SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS k, words FROM v UNION ALL SELECT c, 0, '', 0 FROM h
), n AS (
  SELECT d, k, min(c) AS c, count(*) AS n, any_value(words) AS words FROM p GROUP BY d, k
), q AS (
  SELECT n.*, par.c AS parent FROM n LEFT JOIN n par ON par.d = n.d - 1 AND par.k = left(n.k, 32 * (n.d - 1))
), ch AS (
  SELECT d - 1 AS d, left(k, 32 * (d - 1)) AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY 1, 2
), f AS (
  SELECT q.*, coalesce(ch.children, 0) AS children FROM q LEFT JOIN ch ON ch.d = q.d AND ch.k = q.k
), s AS (
  SELECT a.d, a.k, sum(CASE WHEN f.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN p a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.k
), e AS (
  SELECT p.d, p.k, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) l ON l.c = p.c AND l.d = p.d GROUP BY p.d, p.k
)
SELECT CAST(f.c AS BIGINT) AS conv_id, CAST(f.d AS BIGINT) AS depth, CAST(f.parent AS BIGINT) AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.k = f.k LEFT JOIN e ON e.d = f.d AND e.k = f.k
"""
}

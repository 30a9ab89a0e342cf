"""The conversation prefix trie against a plain Python trie and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from varve.llm import prefix_trie
from varve.llm._tables import kept

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved_tokens, ends)}"""
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    own = {}
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], digest(x[2], x[3]))):
        own.setdefault(c, []).append((role, text))
    members, ends = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_ in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_) - 1) * words
    return {(m[0], len(k)): (members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()) for k, m in members.items()}


def collected(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed):
    r = random.Random(seed)
    stems = [[("user", f"stem {k} {i} word") for i in range(r.choice([2, 5, 9, 14]))] for k in range(6)]
    rows = []
    for c in range(-25, 160):
        if r.random() < 0.2:
            continue
        turns = list(r.choice(stems))[: r.randint(0, 14)]
        for _ in range(r.choice([0, 0, 1, 3])):
            turns.append((r.choice(["user", "assistant", None]), r.choice(["a b", "", None, "a  b", f"t{r.randint(0, 3)}"])))
        turns = turns or [("user", "x")]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(500, i, "user", f"n {i}" if i < 300 else "long") for i in range(400)]
    rows += [(501, i, "user", f"n {i}" if i < 200 else "other") for i in range(350)]
    rows += [(i, 0, "user", "only one") for i in range(600, 640)]
    rows += [(700, None, "user", "null turn"), (700, 1, "user", "again"), (700, 1, "user", "again"), (700, 1, "assistant", "tie"), (None, 0, "user", "nobody")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [1, 4, 7])
def test_trie(spark, block_turns):
    rows = conversations(block_turns)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"words": F.lit("x"), "d": F.lit(1), "total": F.lit(None)})
    assert collected(prefix_trie.trie(df.repartition(3), block_turns)) == plain(rows)


def test_parts_of_a_group(spark):
    """Groups that lie in several partitions get whole totals."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(5)
        rows = [(r.choice([1, 1, 1, 2, 3]), i, r.randint(-(1 << 62), 1 << 62), r.randint(-9, 9)) for i in range(500)]
        got = prefix_trie.running(kept(spark.createDataFrame(rows, "g long, o long, h long, v long"), "test"), "g", ["o"], sums=("v",), xors=("h",))
        assert got.select("g").where("g = 1").count() == sum(x[0] == 1 for x in rows)
        x, v = {}, {}
        want = []
        for g, o, h, n in rows:
            x[g], v[g] = x.get(g, 0) ^ h, v.get(g, 0) + n
            want.append((g, o, x[g], v[g]))
        assert sorted((a["g"], a["o"], a["h_run"], a["v_run"]) for a in got.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_ends(spark):
    """More ids than one row carries."""
    rows = [(c, 0, "user", "hello") for c in range(0, 9000)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert collected(got) == plain(rows)


def test_long_text_and_empty_table(spark):
    rows = [(40, 0, "user", "word " * 400_000), (41, 0, "user", "word " * 400_000), (41, 1, "user", "b")]
    assert collected(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert not prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = con.sql(prefix_trie.SQL["op12_prefix_trie"])
    names = want.columns
    got = prefix_trie.op12_prefix_trie(spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {(r[names.index("conv_id")], r[names.index("depth")]) for r in got} == set(plain(rows))

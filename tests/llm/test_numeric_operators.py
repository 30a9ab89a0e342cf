"""Bit-sliced search, k-d shards, toxicity chains, components and the pipeline."""

import zlib

import numpy as np
import pytest

from varve.llm import bit_slices, kd_shards, toxicity
from varve.llm.components import components


def searched(spark, vectors, queries, **k):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = bit_slices.search(bit_slices.index(df, **k), df.where(queries)).orderBy("query_id", "rank").collect()
    return [tuple(r) for r in got]


def best(rows, on, k=5):
    ok = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if on(i)):
        score = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return out


def test_search_is_exact_with_ties_and_holes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=7)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # one very common vector
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 7), (503, [float("inf")] * 7), (None, [1.0] * 7), (550, [0.0] * 7)]
    want = best(rows, lambda i: i % 50 == 0)
    assert searched(spark, rows, "vec_id % 50 = 0") == want
    assert searched(spark, rows, "vec_id % 50 = 0", rows=64, bits=3) == want


def test_search_of_few_large_and_no_rows(spark):
    rows = [(0, [1e6, -2.0]), (1, [3e6, 1.0]), (50, [-1.0, 0.5])]
    assert searched(spark, rows, "vec_id % 50 = 0") == best(rows, lambda i: i % 50 == 0)
    assert searched(spark, rows[:1], "vec_id % 50 = 0") == [] == searched(spark, rows, "vec_id < 0")


def test_copies_of_a_query_take_no_places(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=7)]) for i in range(1, 300)] + [(0, [4.0] * 7)] * 40
    want = best(rows, lambda i: i == 0)
    assert searched(spark, rows, "vec_id = 0") == want
    assert searched(spark, rows, "vec_id = 0", bits=14) == want


def test_search_in_many_passes_with_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as query_id", "2 as block", "3 as score")
    got = bit_slices.search(bit_slices.index(df, rows=50), df.where("vec_id % 20 = 0"), group_bytes=100).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == best(rows, lambda i: i % 20 == 0)


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.lognormal(5, 1, 3000)]
    texts += ["the same text " * 30] * 1500 + [None, ""] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).selectExpr("*", "1 as shard", "2 as node", "3 as v0")
    return texts, kd_shards.kd_shards(df, 40, parts=8).collect()


def test_shards_are_even_and_slots_gapless(placed):
    texts, rows = placed
    assert len(rows) == len(texts)
    load, slots = {}, {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(load) == list(range(40)) and max(load.values()) < 1.1 * sum(load.values()) / 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r.slot for r in kd_shards.kd_shards(df, 1).collect()) == [0, 1, 2]
    assert kd_shards.kd_shards(df.limit(0), 40).count() == 0
    assert {r.shard for r in kd_shards.kd_shards(df, None, target_bytes=10**6).collect()} == {0}


def test_light_groups_stay_whole_and_heavy_ones_part(spark):
    r = np.random.default_rng(6)
    texts = ["".join(r.choice(list("abcdé "), int(n))) for n in r.lognormal(5, 0.7, 800)]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(7, "one row again and again " * 10)] * 900 + [(5000, "long " * 3000)]
    got = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 20).collect()
    shards, load, total = {}, {}, sum(x["size"] for x in got)
    for x in got:
        shards.setdefault((x.text_crc32, x["size"]), []).append(x.shard)
        load[x.shard] = load.get(x.shard, 0) + x["size"]
    assert all(len(set(s)) == 1 for (_, n), s in shards.items() if n * len(s) <= 0.08 * total / 20)
    # a cut lies off by half a group that stays whole, or by the one long text
    assert max(load.values()) <= 1.1 * total / 20 + 15016 and len(got) == len(rows)
    assert len(set(shards[zlib.crc32(("one row again and again " * 10).encode()), 256])) > 1


def test_cut_is_the_weighted_quantile(spark):
    """The root's cut against all prefixes of the sorted rows."""
    r = np.random.default_rng(7)
    rows = [(int(i), int(s), 0, int(h), int(d), int(v), 0, 1) for i, (s, h, d, v) in enumerate(zip(r.integers(16, 900, 500), r.integers(0, 1 << 60, 500), r.integers(0, 1 << 36, 500), r.integers(0, 40, 500)))]
    df = spark.createDataFrame(rows, "doc_id long, size long, crc long, h long, d long, v0 long, v1 long, node long")
    total = sum(x[1] for x in rows)
    for share in (0.5, 0.3):
        cut = kd_shards.Cut(0, total * share)
        kd_shards._find(df, {1: cut}, 0.0, 0.0)
        before = sum(x[1] for x in rows if (x[5], x[3], x[4]) < tuple(cut.value.values()))
        at = np.append(0, np.cumsum([x[1] for x in sorted(rows, key=lambda x: (x[5], x[3], x[4]))]))
        assert abs(before - total * share) == np.abs(at - total * share).min()


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(0, 3000)}" for _ in range(rng.integers(20, 200))]
        bad = i % 7 == 0
        for _ in range(3 if bad else 0):
            words[rng.integers(0, len(words))] = str(rng.choice(["idiotic", "Scum!", "worthless,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 > 0), int(bad)))
    return rows, labels


def test_chain_on_held_out_documents(spark):
    rows, labels = toxic_rows(900, 4)
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "idiotic " * 20000)], "doc_id long, text string").repartition(3).selectExpr("*", "0 as p_toxic", "1 as quality")
    marks = spark.createDataFrame(labels[:600] + [(None, 1, 1), (8000, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, marks)
    names = [n for n, _ in toxicity.CATEGORIES]
    got = {r.doc_id: r for r in toxicity.score(docs, chain, names).collect()}
    hits = [(got[i].toxic, i % 7 == 0) for i in range(600, 900)]
    assert np.mean([g for g, y in hits if y]) >= 0.95 and np.mean([g for g, y in hits if not y]) <= 0.02
    assert got[9002].toxic and not got[9000].toxic and got[9000].n_words == 0
    assert len(chain[1].earlier) == 1 and len(chain[2].earlier) == 2
    # the chain against its formula, a link at a time
    scored = got[700]
    words = [w for w in rows[700][1].lower().split()]
    counts = {}
    for w in words:
        for f in toxicity.features_of(w):
            counts[f] = counts.get(f, 0) + 1
    p = []
    for link, name in zip(chain, names):
        x = sum(float(w) * (0.5 + 0.5 * min(1.0, 100 * counts[int(f)] / len(words))) for f, w in zip(link.columns, link.weights) if int(f) in counts)
        p.append(1 / (1 + np.exp(-(x + sum(4.0 * (q - 0.5) * float(e) for q, e in zip(p, link.earlier)) + link.bias))))
        assert abs(scored[f"p_{name}"] - p[-1]) < 1e-5 and scored[name] == (scored[f"p_{name}"] >= link.threshold)
    assert toxicity.score(docs.union(docs.where("doc_id < 5")), chain, names).count() == 908
    none = toxicity.score(docs, toxicity.train(docs, marks.limit(0)), names)
    assert {(r.p_toxic, r.toxic) for r in none.collect()} == {(0.0, False)} and toxicity.score(docs.limit(0), chain, names).count() == 0

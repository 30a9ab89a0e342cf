"""SimHash near duplicates against all pairs."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from varve.llm import simhash

from .brute import WORD

SMALL = "/root/testdata/sf0.001"
EDGES = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "a"), (9004, "A  b"), (9005, "\na b\tc d\n"), (9006, "Ä É ö \n u v  w "), (9007, "x" * 20000), (9008, "a b c d")]


def fingerprint(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(len(words) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """{id: smallest id reachable} over all pairs of {id: fingerprint}"""
    ids = sorted(fps)
    root = {i: i for i in ids}
    f = np.array([fps[i] for i in ids], np.uint64)
    changed = True
    while changed:  # every id takes the smallest root of its neighbours
        changed = False
        for k, i in enumerate(ids):
            low = min(root[ids[j]] for j in np.flatnonzero(np.bitwise_count(f ^ f[k]) <= radius))
            changed, root[i] = changed or low < root[i], low
    return root


def collected(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def wanted(rows):
    fps = {i: fingerprint(t) for i, t in rows}
    root = components(fps)
    return {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_masks_cover_every_set_of_bits():
    r = random.Random(0)
    for radius, round_ in itertools.product((1, 2, 3, 4), (0, 1, 2)):
        masks = simhash.covering_masks(radius, round_)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            differ = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not differ & m for m in masks)


def test_fingerprints():
    r = random.Random(1)
    given = [t for _, t in EDGES] + [" ".join(r.choice(["a", "Be", "çé", "d,"]) for _ in range(n)) for n in (3, 4, 5, 200, 70_000)]
    assert simhash.fingerprints(pa.array(given, pa.string()), 4).view(np.uint64).tolist() == [fingerprint(t) for t in given]


@pytest.mark.parametrize("most", [4096, 8])
def test_links_connect_what_all_pairs_connect(spark, most):
    """Dense groups, chains and strays; with small buckets the hot ones are covered again and again."""
    r = random.Random(2)
    fps = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        near = {centre}
        while len(near) < 120:
            near.add(r.choice(sorted(near)) ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 4, 5]))))
        fps |= near
    fps = {i: f for i, f in enumerate(sorted(fps | {r.getrandbits(64) for _ in range(200)}))}
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in fps.items()], "fp long, rep long")
    parent = {i: i for i in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in simhash.links(classes, 4, most).collect():
        assert (fps[a] ^ fps[b]).bit_count() <= 4
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in fps} == components(fps)


def test_near_duplicates(spark):
    r = random.Random(3)
    rows = list(EDGES)
    for _ in range(20):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.choice([2, 5, 80, 300]))]
        for _ in range(r.choice([1, 2, 6])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1])):
                words[r.randrange(len(words))] = "Z"
            rows.append((len(rows), r.choice([" ", "\n "]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "key": F.lit(1), "rep": F.lit(None), "id": F.lit(2)})
    assert collected(simhash.near_duplicates(df.repartition(3))) == wanted(rows)


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "q r s t"), (2, None), (None, "a b c d e"), (None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"]) == [(1, f"{fingerprint(rows[0][1]):016x}", 1), (2, "0" * 16, 2)]
    assert sorted((r["fingerprint"], r["component_id"]) for r in got if not r["doc_id"]) == [("0" * 16, None), (f"{fingerprint(rows[0][1]):016x}", None)]
    assert not simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count()


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert collected(simhash.op11_simhash_covering(spark, SMALL)) == wanted(rows)

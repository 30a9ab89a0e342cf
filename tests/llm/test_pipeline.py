"""The pipeline's stages on a table of their own, and the registered queries against their SQL."""

import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from varve.llm import registry

from .brute import WORD, near_components, without_repeats

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = "cat sat mat dog ran far home day sun moon rain sea".split()
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(20)) + "." for _ in range(5))
        rows.append((i, text, "en", "s", len(text)))
    rows += [(100 + i, rows[i][1] + " more", "en", "t", len(rows[i][1]) + 5) for i in range(10)]
    rows += [(200, rows[3][1][:600] + " " + " ".join(f"z{i}" for i in range(300)), "en", "t", 0), (201, "short", "en", "t", 5), (202, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    kept = stages["quality"](spark, docs, SMALL)
    assert kept.columns == docs.columns and not {201, 202} & {r.doc_id for r in kept.collect()}
    base = {r.doc_id: r.text for r in docs.collect()}
    near = stages["near_duplicates"](spark, docs, SMALL)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in near_components(base.items()).items() if c == i}
    cut = stages["repeated_passages"](spark, near, SMALL)
    want = without_repeats([(r.doc_id, r.text) for r in near.collect()])
    assert all(len(WORD.findall(r.text or "")) == want[r.doc_id][0] - want[r.doc_id][1] for r in cut.collect()) and any(w[1] for w in want.values())
    assert stages["personal_data"](spark, cut, SMALL).columns == docs.columns
    pieces = stages["packing"](spark, cut, SMALL)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in cut.collect()}


def test_stages_of_odd_tables(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    copies = docs.where("doc_id in (0, 1)")
    odd = docs.where("doc_id < 10").union(copies).union(copies.selectExpr("cast(null as long)", "text || ' x'", "lang", "source", "n_chars")).selectExpr("*", "1 as near_id", "2 as rid", "'k' as kept", "3 as n_replaced", "4 as offset")
    got = stages["near_duplicates"](spark, odd.drop("near_id"), SMALL)
    assert sorted(r.doc_id for r in got.collect()) == list(range(10)) and got.columns == odd.drop("near_id").columns
    for name, stage in stages.items():
        empty = stage(spark, odd.drop("near_id").limit(0), SMALL)
        assert empty.count() == 0 and (name == "packing" or empty.columns == odd.drop("near_id").columns)
        rows = stage(spark, odd.drop("near_id"), SMALL)
        assert rows.count() > 0 and (name == "packing" or rows.columns == odd.drop("near_id").columns)


def test_names_that_clash_with_those_set_aside(spark, docs):
    odd = docs.where("doc_id < 12").selectExpr("*", "1 as x", "2 as _extra_5", "3 as Near_ID", "4 as __EXTRA_6", "5 as _extra_")
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, odd, SMALL)
        assert rows.columns == odd.columns and rows.count() > 0, name
        assert {tuple(r)[5:] for r in rows.collect()} == {(1, 2, 3, 4, 5)}


def test_a_long_text(spark, docs):
    """A text of megabytes goes through every stage, whole."""
    r = random.Random(4)
    long = "\n".join(" ".join(f"{r.choice(('cat', 'sat', 'mat', 'far', 'home'))}{r.randint(0, 99999)}" for _ in range(12)) + "." for _ in range(30_000))
    rows = docs.where("doc_id < 3").union(spark.createDataFrame([(900, long, "en", "s", len(long)), (901, long + " once more", "en", "s", len(long) + 10)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, stages["quality"](spark, rows, SMALL), SMALL)
    assert 900 in (ids := {r.doc_id for r in near.collect()}) and 901 not in ids
    last = stages["personal_data"](spark, stages["repeated_passages"](spark, near, SMALL), SMALL)
    assert {r.doc_id: r.text for r in last.collect()}[900].split() == long.split()
    pieces = [(r.start, r.length, r.doc_tokens) for r in stages["packing"](spark, last, SMALL).where("doc_id = 900").collect()]
    at = 0
    for start, length, whole in sorted(pieces):
        assert start == at
        at += length
    assert at == whole


def test_run(spark):
    """Stage by stage against plain Python, each on what its predecessor kept."""
    from tokenizers import Tokenizer

    from varve.llm import line_quality, pseudonyms

    import public_tokenizers

    read = spark.read.parquet(f"{SMALL}/documents.parquet")
    field = line_quality.train(read, spark.read.parquet(f"{SMALL}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in line_quality.judge(read, field).collect()}
    texts = {r.doc_id: r.text for r in read.collect() if verdict[r.doc_id]}
    first = near_components(texts.items())
    texts = {i: t for i, t in texts.items() if first[i][1] == i}
    cut = without_repeats(texts.items())
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    same = pseudonyms.pseudonymise(spark.createDataFrame([(i, t) for i, t in texts.items() if not cut[i][1]], "doc_id long, text string"), pseudonyms.DEMO_KEY).collect()
    assert same and all(whole[r.doc_id] == len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in same)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()[list(got.columns)]
    rows = [sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[list(got.columns)].astype(object).values.tolist()), key=str) for df in (got, want)]
    assert rows[0] == rows[1]

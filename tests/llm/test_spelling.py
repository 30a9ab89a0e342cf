"""Spelling variants against plain Python and the query's SQL."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.llm import spelling

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def counts(rows):
    out = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """{word: (form, root, n, n_near, form_n)}"""
    n = {w: k for w, k in counts(rows).items() if len(w) >= 6 and k >= 5}
    form, many = {}, {}
    for w in n:
        found = sorted((-n[x], x) for x in n if near(w, x))
        many[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], many[w], n.get(form[w])) for w in n}


def collected(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(seed):
    r = random.Random(seed)
    stems = ["abcdef", "aaaaaaa", "aaaaaaaa", "aaaaaa", "ababab", "bababa", "chevaux", "ÉTUDEs", "étudiant", "strassen", "zwölfte", "x×y÷zz", "letters"]
    often = collections.Counter()
    for w in stems:
        often[w] += r.choice([5, 30, 200])
        for _ in range(6):
            at, v = r.randrange(len(w) + 1), w
            for _ in range(r.choice([1, 1, 2])):
                v = r.choice([v[:at] + v[at + 1 :], v[:at] + r.choice("abzéÖ") + v[at:], v[:at] + r.choice("abzéÖ") + v[at + 1 :]])
            often[v] += r.choice([1, 4, 5, 6, 30])
    words = [w for w, k in often.items() for _ in range(k)]
    r.shuffle(words)
    rows = [(i, r.choice([" ", "-", "\n3"]).join(words[20 * i : 20 * i + 20])) for i in range(len(words) // 20)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "q" * 4000), (9003, "q" * 4000), (None, "nameless " * 7), (9004, "q" * 4001 + " " + "q" * 4000), (9005, ("q" * 4000 + " ") * 7)]


@pytest.mark.parametrize("symbols", [1, 3, 6])
def test_neighbourhoods_reach_every_near_word(symbols):
    """Each near word's own keys have one of the word's neighbours."""
    r = random.Random(symbols)
    for _ in range(60):
        w = "".join(r.choice("abcdéfg") for _ in range(r.randint(6, 13)))
        keys = set(np.concatenate([k.ravel() for k in spelling.Reduced([w], symbols).neighbours()]).tolist())
        for at in range(len(w) + 1):
            for v in (w[:at] + w[at + 1 :], w[:at] + r.choice("abcÿ") + w[at:], w[:at] + r.choice("abcÿ") + w[at + 1 :]):
                if near(v, w):
                    assert keys & set(spelling.Reduced([v], symbols).keys().ravel().tolist()), (w, v)


def test_neighbours_in_parts(monkeypatch):
    """A word whose neighbours don't fit an array has the same ones in parts."""
    words = ["abcdefgh" * 5, "abcdefgx" * 5]
    whole = [np.hstack(list(spelling.Reduced(words, 4).neighbours()))]
    monkeypatch.setattr(spelling, "_AT_ONCE", 64)
    parts = list(spelling.Reduced(words, 4).neighbours())
    assert len(parts) > 3
    for i in range(2):
        assert set(np.hstack(parts)[i].tolist()) == set(whole[0][i].tolist())
    part = pa.RecordBatch.from_pydict({"word": ["abcdef", "abcdefg", "abcdeg"]})
    assert sorted(i for rows, _ in spelling._by_length(part, 4) for i in rows.tolist()) == [0, 1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("x"), "n": F.lit(1), "id": F.lit(None)})
    want = plain(rows)
    assert any(v[0] for v in want.values())
    for symbols in (2, 6):
        assert collected(spelling.variants(df.repartition(4), symbols=symbols)) == want


def test_long_chain_of_forms(spark):
    words, rows = ["abcdefgh"], []
    for i in range(4):
        words.append(words[-1] + "xyzv"[i])
    for k, w in enumerate(words):
        rows += [(10_000 + k, f"{w} " * (5 * 6**k))]
    got = collected(spelling.variants(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)


def test_empty_table(spark):
    assert not spelling.variants(spark.createDataFrame([], SCHEMA)).count()
    assert not spelling.variants(spark.createDataFrame([(1, None)], SCHEMA)).count()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(spelling.SQL["op13_spelling_variants"])
    got = spelling.op13_spelling_variants(spark, SMALL)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r["word"]: r["n"] for r in got.collect()} == {w: k for w, k in counts(rows).items() if len(w) >= 6 and k >= 5}

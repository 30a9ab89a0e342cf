"""Passages of a reference, by broadcast automata, against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from varve.llm import reference_automata, substring_dedup

from .brute import WORD
from .test_text_operators import EDGES, frame


def brute(rows, reference, window=13):
    known = {tuple(w[j : j + window]) for w in (WORD.findall(t or "") for t in reference) for j in range(len(w) - window + 1)}
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if tuple(words[j : j + window]) in known:
                gone[j : j + window] = [True] * window
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def given(seed):
    r = random.Random(seed)
    items = [[f"b{r.randint(0, 9)}" for _ in range(r.choice([3, 13, 20, 60, 400]))] for _ in range(40)]
    rows = []
    for i in range(120):
        words = [f"b{r.randint(0, 9)}" if r.random() < 0.3 else f"w{r.randint(0, 99)}" for _ in range(r.choice([0, 4, 50, 200]))]
        for _ in range(r.randint(0, 3)):
            item = r.choice(items)
            a = r.randrange(len(item))
            at = r.randint(0, len(words))
            words[at:at] = item[a : a + r.randint(1, 60)]
        rows.append((i, " ".join(words)))
    return [*rows, *EDGES], [" ".join(w) for w in items] + [None, "", "a " * 30]


def removed(df, reference, **k):
    return sorted(map(tuple, substring_dedup.digests(reference_automata.remove(df, reference, **k)).collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"shard_words": 40, "gram": 2}, {"shard_words": 300, "group_bytes": 60_000}])
def test_passages_of_a_reference(spark, limits):
    rows, reference = given(1)
    want = brute(rows, reference)
    assert sum(w[2] > 0 for w in want) > 30
    assert removed(frame(spark, rows), spark.createDataFrame([(t,) for t in reference], "text string"), **limits) == want


def test_passages_of_odd_tables(spark):
    passage = " ".join(f"u{i}" for i in range(20))
    rows = [(1, passage), (1, passage), (None, f"x {passage} y"), (2, None), (3, ""), (4, f"{passage} " * 9000)]
    df = frame(spark, rows).selectExpr("doc_id", "text", "'m' as shard", "5 as rid", "array(1) as tags", "2 as cuts", "3 as n_words")
    reference = spark.createDataFrame([(passage, 1), (passage, 2), (None, 3)], "text string, cuts int")
    assert removed(df, reference) == brute(rows, [passage])
    got = reference_automata.remove(df, reference)
    assert got.columns == ["doc_id", "text", "shard", "rid", "tags", "n_words", "n_removed"] and {r.text for r in got.where("doc_id = 2").collect()} == {None}
    assert removed(df, reference.limit(0)) == brute(rows, []) and removed(df.limit(0), reference) == []


def test_arrays_are_the_automaton():
    r = random.Random(3)
    for _ in range(40):
        sequences = [np.array([r.randint(1, 3) for _ in range(r.randint(2, 20))], np.uint64) for _ in range(4)]
        automaton = substring_dedup.Automaton()
        for s in sequences:
            automaton.add(s.tolist())
        shard = reference_automata.Shard.load(reference_automata.Shard.of(sequences, 2).dump())
        queries = sorted(([r.randint(1, 4) for _ in range(r.randint(1, 30))] for _ in range(5)), key=len, reverse=True)
        count = np.array([len(q) for q in queries])
        first = np.cumsum(count) - count
        symbols = reference_automata._among(np.concatenate([np.array(q, np.uint64) for q in queries]), shard.words)
        symbols[symbols < 0] = len(shard.words)
        got = np.zeros(len(symbols), int)
        for place, m in shard.statistics(symbols, first, count):
            got[place] = m
        assert got.tolist() == [m for q in queries for m in automaton.statistics(q)]
        words = sum(map(len, sequences))
        assert len(shard.link) <= 2 * words and len(shard.key) <= 3 * words


def test_groups_of_shards():
    blobs = [b"a" * n for n in (5, 5, 11, 1, 1)]
    assert [[len(b) for b in g] for g in reference_automata.groups(blobs, 10)] == [[5, 5], [11], [1, 1]]
    assert list(reference_automata.groups([], 10)) == []

"""Moments of a stream against the batch job on the rows that count."""

import numpy as np
import pytest

from varve.operators import association
from varve.streaming.moments import ROWS, Moments


def equal(state, spark, rows):
    """The stream's statistics are those of the newest rows."""
    newest = {}
    for c, g, version, x, y, v in rows:
        if (c, g) not in newest or version >= newest[c, g][0]:
            newest[c, g] = version, x, y, v
    chunks = spark.createDataFrame([(c, g, x) for (c, g), (_, x, _, _) in newest.items()], "chunk_id int, gene string, x array<double>")
    basis = spark.createDataFrame([(g, y, v) for (c, g), (_, _, y, v) in newest.items() if c == 0], "gene string, y double, v array<double>")
    want = {(r["chunk_id"], r["pos"]): r for r in association.marginal(chunks, basis).collect()}
    got = {(r["chunk_id"], r["pos"]): r for r in state.marginal().collect()}
    assert set(got) == set(want)
    for at, r in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) <= 1e-6 * max(1, abs(a))) for a, b in zip(r, got[at])), (at, r, got[at])


def given(rng, genes, version):
    out = []
    for g in genes:
        y, v = float(rng.normal()), [1.0, float(rng.normal())]
        out += [(c, f"g{g}", version, [float(a) for a in (1e6 + rng.normal(size=3) if c else [*rng.normal(size=2), 5.0])], y, v) for c in (0, 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_replays_and_restarts(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    state, rows, batches = Moments(spark, str(tmp_path / "s")), [], []
    for b in range(5):
        own = given(rng, rng.choice(40, 15, replace=False), int(rng.integers(0, 3)))  # new genes, revisions, and stale ones
        batches.append(own)
        rows += own
        df = spark.createDataFrame(own, ROWS).repartition(3)
        state.add(df, b)
        if b in (1, 3):
            state.add(df, b)  # again
        if b == 2:
            state = Moments(spark, str(tmp_path / "s"))
    equal(state, spark, rows)
    state.add(spark.createDataFrame(batches[-1], ROWS), 4)
    equal(state, spark, rows)
    state.add(spark.createDataFrame([], ROWS), 5)
    state.add(spark.createDataFrame(given(rng, [50], 0) * 3, ROWS), 6)  # repeated rows
    assert {r["n"] for r in state.marginal().select("n").collect()} == {len({g for _, g, *_ in rows}) + 1}


def test_a_stream_that_goes_on(spark, tmp_path):
    rng, rows = np.random.default_rng(3), []
    folder = str(tmp_path / "in")
    for k in range(3):
        own = given(rng, range(10 * k, 10 * k + 14), k)  # four genes come again
        rows += own
        spark.createDataFrame(own, ROWS).coalesce(1).write.mode("append").parquet(folder)
        state = Moments(spark, str(tmp_path / "state"))
        state.follow(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder))
        equal(state, spark, rows)
    with pytest.raises(ValueError, match="no batch"):
        Moments(spark, str(tmp_path / "none")).marginal()

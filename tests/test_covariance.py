"""Ragged and tiled factors, whitening, eigenvalues and array sources, against dense algebra."""

import numpy as np
import pytest

from varve.operators import association, covariance, predict, skyline, tiles
from varve.sources import arrays, matrices


def ragged(rng, n, reach, scale=0.2):
    m = np.minimum(np.arange(n), rng.integers(0, reach + 1, n))
    return [rng.normal(size=k) * scale for k in m]


def frame(spark, blocks):
    """{chr: tails} as blocks of genes <chr>_<i>."""
    rows = [(c, len(tails) * k + i, f"{c}_{i}", i, [float(v) for v in t], 1.0) for k, (c, tails) in enumerate(blocks.items()) for i, t in enumerate(tails)]
    return spark.createDataFrame(rows, "chr string, y_idx long, gene string, i long, r array<double>, d double").repartition(3)


def dense(tails):
    return covariance.dense_block(np.arange(len(tails)), tails)


def factor(rows, chr_, n):
    out, got = np.zeros((n, n)), rows.where(f"chr = '{chr_}'").collect()
    assert len(got) == n
    for r in got:
        out[r["i"], r["i"] - len(r["l"]) : r["i"]] = r["l"]
        out[r["i"], r["i"]] = r["dl"]
    return out


@pytest.fixture(scope="module")
def blocks():
    rng = np.random.default_rng(0)
    return {"1": ragged(rng, 150, 7), "2": ragged(rng, 90, 80), "3": [np.zeros(0)] * 5, "4": ragged(rng, 1, 0), "5": ragged(rng, 64, 3)}


def test_factors_and_whitening(spark, blocks):
    rng, df = np.random.default_rng(1), frame(spark, blocks)
    added = 0.1 - min(np.linalg.eigvalsh(dense(t))[0] for t in blocks.values())
    rows = covariance.factors(df, added)
    low = {c: np.linalg.cholesky(dense(t) + added * np.eye(len(t))) for c, t in blocks.items()}
    for c, t in blocks.items():
        assert np.allclose(factor(rows, c, len(t)), low[c])
    x = {(k, c): rng.normal(size=(len(t), 3 + k)) for k in (0, 1) for c, t in blocks.items()}
    values = spark.createDataFrame([(k, f"{c}_{i}", [float(a) for a in row]) for (k, c), v in x.items() for i, row in enumerate(v)], "chunk_id int, gene string, x array<double>").repartition(5)
    got = covariance.whiten(values, rows).collect()
    assert len(got) == sum(len(v) for v in x.values())
    want = {k: np.linalg.solve(low[k[1]], v) for k, v in x.items()}
    assert all(np.allclose(r["x"], want[r["chunk_id"], r["chr"]][r["i"]]) and r["gene"] == f"{r['chr']}_{r['i']}" for r in got)
    with pytest.raises(Exception, match="without values"):
        covariance.whiten(values.where("gene <> '1_149'"), rows).collect()
    with pytest.raises(Exception, match="without values before"):
        covariance.whiten(values.where("gene <> '2_3'"), rows).collect()
    with pytest.raises(Exception, match="two rows of values"):
        covariance.whiten(values.union(values.where("gene = '5_9' and chunk_id = 1")), rows).collect()
    with pytest.raises(Exception, match="not positive definite"):
        covariance.factors(df, added - 0.2).collect()


def test_columns_in_slices(spark, blocks, monkeypatch):
    """A factor that reaches far back takes few columns at a time."""
    rng, tails = np.random.default_rng(2), blocks["2"]
    rows = covariance.factors(frame(spark, {"2": tails}), 9.0)
    x = rng.normal(size=(len(tails), 150))
    values = spark.createDataFrame([(0, f"2_{i}", [float(a) for a in row]) for i, row in enumerate(x)], "chunk_id int, gene string, x array<double>")
    monkeypatch.setattr(skyline, "HELD", 1)
    got = {r["i"]: r["x"] for r in covariance.whiten(values, rows).collect()}
    want = np.linalg.solve(np.linalg.cholesky(dense(tails) + 9 * np.eye(len(tails))), x)
    assert np.allclose([got[i] for i in range(len(tails))], want)


def test_held_strips_follow_the_band():
    rng, held = np.random.default_rng(3), []
    tails = ragged(rng, 2000, 20)
    strips = skyline.Strips(20)
    for k in range(0, 2000, skyline.TILE):
        strips.push(tails[k : k + skyline.TILE], np.full(skyline.TILE, 20.0)[: len(tails[k : k + skyline.TILE])])
        held.append(sum(s[1].size for s in strips.strips))
    assert max(held[3:]) <= 2 * skyline.TILE * (20 + 2 * skyline.TILE)


@pytest.mark.parametrize("steps", [4, 96])
def test_smallest_eigenvalue(spark, blocks, steps):
    for tails in blocks.values():
        assert abs(skyline.smallest_eigenvalue(tails, np.ones(len(tails)), steps) - np.linalg.eigvalsh(dense(tails))[0]) < 1e-8
    got = {r["chr"]: r["low"] for r in covariance.smallest_eigenvalue(frame(spark, blocks)).collect()}
    assert all(abs(got[c] - np.linalg.eigvalsh(dense(t))[0]) < 1e-8 for c, t in blocks.items())


def test_masks_and_labels_recut_rows(spark, blocks):
    some = {c: blocks[c] for c in ("1", "2", "5")}
    df = frame(spark, some)
    keep = [f"{c}_{i}" for c, t in some.items() for i in range(len(t)) if (i * 7 + len(c)) % 3]
    got = covariance.masked_blocks(df, spark.createDataFrame([(g,) for g in keep], "gene string")).collect()
    assert sorted(r["gene"] for r in got) == sorted(keep)
    for c, t in some.items():
        on = np.array([f"{c}_{i}" in keep for i in range(len(t))])
        own = sorted((r for r in got if r["chr"] == c), key=lambda r: r["i"])
        assert [r["i"] for r in own] == list(range(on.sum()))
        assert np.allclose(covariance.dense_block(np.arange(len(own)), [r["r"] for r in own]), dense(t)[np.ix_(on, on)])
    label = {f"{c}_{i}": "AB"[(i // 5 + len(t)) % 2] for c, t in some.items() for i in range(len(t))}
    own = spark.createDataFrame(list(label.items()), "gene string, own string")
    got = covariance.regrouped(df.join(own, "gene")).collect()
    for a in "AB":
        rows = sorted((r for r in got if r["chr"] == a), key=lambda r: r["i"])
        m = covariance.dense_block(np.arange(len(rows)), [r["r"] for r in rows])
        at = [r["gene"].split("_") for r in rows]
        want = np.array([[1.0 if p == q else dense(some[p[0]])[int(p[1]), int(q[1])] if p[0] == q[0] else 0.0 for q in at] for p in at])
        assert sorted(r["gene"] for r in rows) == sorted(g for g, v in label.items() if v == a) and np.allclose(m, want)


@pytest.mark.parametrize("n, reach, side", [(500, 500, 64), (130, 9, 32), (64, 64, 64), (65, 64, 64)])
def test_tiled_factor(spark, n, reach, side):
    rng = np.random.default_rng(n)
    tails = [rng.normal(size=i) * 0.2 for i in range(n)] if reach >= n - 1 else ragged(rng, n, reach)
    got = tiles.tiled(frame(spark, {"7": tails}), n, 12.0, side)
    assert np.allclose(factor(got, "7", n), np.linalg.cholesky(dense(tails) + 12 * np.eye(n)))


def test_large_blocks_go_to_tiles(spark, blocks, monkeypatch):
    monkeypatch.setattr(skyline, "LARGE", 8 * 1200)
    monkeypatch.setattr(tiles, "SIDE", 32)
    rows = covariance.factors(frame(spark, blocks), 9.0)
    for c, t in blocks.items():
        assert np.allclose(factor(rows, c, len(t)), np.linalg.cholesky(dense(t) + 9 * np.eye(len(t))))
    assert {(r["chr"], r["n"], r["band"]) for r in rows.select("chr", "n", "band").distinct().collect()} == {(c, len(t), max(map(len, t))) for c, t in blocks.items()}


def sparse(path, m, kind):
    """What scipy writes for a compressed sparse matrix."""
    a = m.T if kind == "csc" else m
    row, col = np.nonzero(a)
    if kind == "coo":
        np.savez_compressed(path, row=row, col=col, data=a[row, col], shape=m.shape, format=kind.encode())
    else:
        np.savez_compressed(path, indices=col, indptr=np.searchsorted(row, np.arange(len(a) + 1)), data=a[row, col], shape=m.shape, format=kind.encode())


@pytest.mark.parametrize("kind", ["npy", "f4", "by_columns", "csr", "csc", "coo"])
def test_covariance_files(spark, tmp_path, kind):
    rng, n = np.random.default_rng(5), 40
    m = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3)
    m = m + m.T
    path = str(tmp_path / ("c.npz" if kind.startswith("c") else "c.npy"))
    if kind.startswith("c"):
        sparse(path, m, kind)
    else:
        np.save(path, {"npy": m, "f4": m.astype("<f4"), "by_columns": np.asfortranarray(m)}[kind])
    target = spark.createDataFrame([(i, f"g{i}") for i in range(n)], "y_idx long, gene string")
    labels = spark.createDataFrame([(f"g{i}", str(i % 3)) for i in range(n)], "gene string, chr string")
    got = matrices.read_covariance(spark, path, target, labels, partition_bytes=1000).collect()
    for c in range(3):
        own = sorted((r for r in got if r["chr"] == str(c)), key=lambda r: r["i"])
        assert [r["y_idx"] for r in own] == list(range(c, n, 3)) and [len(r["r"]) for r in own] == list(range(len(own)))
        assert np.allclose(covariance.dense_block(np.arange(len(own)), [r["r"] for r in own], np.array([r["d"] for r in own])), m[c::3, c::3], atol=1e-6)
    with pytest.raises(Exception, match="the target has 39"):
        matrices.read_covariance(spark, path, target.where("y_idx < 39"), labels).collect()
    with pytest.raises(ValueError, match="lack an annotation"):
        matrices.read_covariance(spark, path, target, labels.where("chr <> '1'"))


def test_array_source(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = [rng.normal(size=(50, 7)), rng.integers(0, 9, (50, 2)), np.zeros((50, 0))]
    for i, a in enumerate(x):
        np.save(tmp_path / f"m.{i}.npy", a)
    df = arrays.array_rows(spark, f"{tmp_path}/m", 3, partition_bytes=200, rows_at_once=2)
    assert df.rdd.getNumPartitions() > 15
    got = df.collect()
    assert len(got) == 150 and all(np.array_equal(r["x"], x[r["chunk_id"]][r["row_idx"]]) for r in got)
    np.save(tmp_path / "f.0.npy", np.asfortranarray(x[0]))
    with pytest.raises(Exception, match="columns first"):
        arrays.array_rows(spark, f"{tmp_path}/f", 1).collect()
    (tmp_path / "m.1.npy").write_bytes((tmp_path / "m.1.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends early"):
        arrays.array_rows(spark, f"file://{tmp_path}/m", 2).collect()


def test_array_sink(spark, tmp_path):
    """Parts of many tasks make whole arrays; a missing or repeated row leaves nothing behind."""
    rng = np.random.default_rng(7)
    x = [rng.normal(size=(90, 4)), rng.normal(size=(90, 1))]
    df = spark.createDataFrame([(c, i, [float(v) for v in row]) for c, a in enumerate(x) for i, row in enumerate(a)], "chunk_id int, row_idx long, x array<double>").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):  # the second time over the first
            arrays.write_array_rows(df, str(tmp_path / "w"))
        assert all(np.array_equal(np.load(tmp_path / f"w.{i}.npy"), a) for i, a in enumerate(x)) and len(list(tmp_path.iterdir())) == 2
        assert arrays.array_rows(spark, str(tmp_path / "w"), 2).count() == 180
        for wrong in (df.where("row_idx <> 17"), df.union(df.where("row_idx = 17"))):
            with pytest.raises(Exception, match="chunk 0 has no row 17|chunk 0 has no row 18|or one twice"):
                arrays.write_array_rows(wrong, str(tmp_path / "v"))
        assert sorted(p.name for p in tmp_path.iterdir()) == ["w.0.npy", "w.1.npy"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_genes_are_errors(spark):
    chunks = spark.createDataFrame([(0, g, [float(v)]) for g, v in zip("abca", (1, 2, 4, 1))], "chunk_id int, gene string, x array<double>")
    basis = spark.createDataFrame([(g, float(v), [1.0]) for g, v in zip("abc", (1, 3, 2))], "gene string, y double, v array<double>")
    with pytest.raises(ValueError, match=r"several rows of values: \['a'\]"):
        association.marginal(chunks, basis)
    coefs = spark.createDataFrame([(0, 0, 1.0)], "chunk_id int, pos int, beta double")
    with pytest.raises(Exception, match="several rows of values: a"):
        predict.predict(chunks, coefs).collect()
    assert {r["gene"]: r["score"] for r in predict.predict(chunks.distinct(), coefs).collect()} == {"a": 1.0, "b": 2.0, "c": 4.0}


@pytest.mark.parametrize("rho", [0.3, -0.7])
def test_autoregressive_whitening(spark, rho):
    """The inverse factor's rows whiten as the dense factor does, and stay one number wide."""
    rng, sizes = np.random.default_rng(8), {"1": 1, "2": 2, "3": 64, "4": 300}
    genes = [(c, 10 * i + int(c), f"{c}_{i}") for c, n in sizes.items() for i in range(n)]
    rows = covariance.autoregressive(spark.createDataFrame(genes, "chr string, y_idx long, gene string").repartition(3), rho)
    assert {r["chr"]: (r["n"], r["band"]) for r in rows.collect()} == {c: (n, min(1, n - 1)) for c, n in sizes.items()}
    assert max(len(r["l"]) for r in rows.collect()) == 1
    x = {c: rng.normal(size=(n, 3)) for c, n in sizes.items()}
    values = spark.createDataFrame([(0, f"{c}_{i}", [float(a) for a in row]) for c, v in x.items() for i, row in enumerate(v)], "chunk_id int, gene string, x array<double>").repartition(5)
    got = covariance.whiten(values, rows, inverse=True).collect()
    assert len(got) == len(genes)
    for c, n in sizes.items():
        want = np.linalg.solve(np.linalg.cholesky(rho ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))), x[c])
        own = sorted((r for r in got if r["chr"] == c), key=lambda r: r["i"])
        assert [r["gene"] for r in own] == [f"{c}_{i}" for i in range(n)] and np.allclose([r["x"] for r in own], want, rtol=0, atol=1e-12)
    with pytest.raises(Exception, match="without values"):
        covariance.whiten(values.where("gene <> '4_299'"), rows, inverse=True).collect()


def test_long_narrow_blocks_are_no_tiles(spark, monkeypatch):
    tails = ragged(np.random.default_rng(9), 900, 3)
    monkeypatch.setattr(skyline, "LARGE", 8 * 1000)  # the factor has more numbers, its strips fewer
    monkeypatch.setattr(tiles, "tiled", None)
    rows = covariance.factors(frame(spark, {"1": tails}), 9.0)
    assert np.allclose(factor(rows, "1", 900), np.linalg.cholesky(dense(tails) + 9 * np.eye(900)))


def test_smallest_eigenvalue_of_inverse_factors(spark):
    """From the ragged rows of the inverse factor, whatever its band."""
    rng = np.random.default_rng(10)
    for tails in (ragged(rng, 200, 5), ragged(rng, 90, 60), [np.zeros(0)]):
        diagonal = 0.5 + rng.random(len(tails))
        w = np.tril(dense(tails), -1) + np.diag(diagonal)
        product, own = skyline._precision(tails, diagonal)
        assert np.allclose(covariance.dense_block(np.arange(len(tails)), product, own), w @ w.T)
        assert [len(t) for t in product] == [len(t) for t in tails]
    sizes = {"1": 1, "2": 2, "3": 64, "4": 700}
    rows = covariance.autoregressive(spark.createDataFrame([(c, i, f"{c}_{i}") for c, n in sizes.items() for i in range(n)], "chr string, y_idx long, gene string"), 0.3)
    got = {r["chr"]: r["low"] for r in covariance.smallest_eigenvalue(rows, inverse=True).collect()}
    for c, n in sizes.items():
        want = np.linalg.eigvalsh(0.3 ** np.abs(np.subtract.outer(np.arange(n), np.arange(n))))[0]
        assert abs(got[c] - want) < 1e-8

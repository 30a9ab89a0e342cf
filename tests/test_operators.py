"""Hand-checked inputs for the engine's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions.stats import alphas, chi2_sf1, erfc
from varve.operators import association, covariance, fit, masks, munge, predict, project, select


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_hla_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0, "6", 19999999.0), (1, "6", 20e6), (2, "6", 40e6), (3, "6", 40000001.0), (4, "16", 30e6)], "i int, chr string, tss double")
    assert [r[1] for r in rows(df.select("i", masks.is_hla(F.col("chr"), F.col("tss"))), "i")] == [False, True, True, False, False]


def test_mask_leaves_out_unannotated_genes(spark):
    annotation = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0)], "gene string, chr string, tss double")
    target = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "gene string, y double")
    assert rows(masks.gene_mask(target, annotation, ["1"]).select("gene", "used"), "gene") == [("a", True), ("b", False), ("c", False)]
    with pytest.raises(ValueError):
        masks.checked_chromosomes(annotation, ["9"])


def test_natural_order(spark):
    df = spark.createDataFrame([("10",), ("2",), ("X",), ("1",)], "chr string")
    assert [r[0] for r in df.orderBy(*masks.natural_order(F.col("chr"))).collect()] == ["1", "2", "10", "X"]


def test_ragged_rows_to_covariance_and_factor(spark):
    raw = spark.createDataFrame([(0, "a", "1", []), (1, "b", "1", [0.2]), (2, "c", "1", [0.1, 0.3])], "y_idx long, gene string, chr string, r array<double>")
    blocks = covariance.block_rows(raw)
    assert np.allclose(covariance.dense_block(np.arange(3), [[], [0.2], [0.1, 0.3]]), [[1, 0.2, 0.1], [0.2, 1, 0.3], [0.1, 0.3, 1]])
    assert abs(covariance.smallest_eigenvalue(blocks).first()["low"] - 0.67980882) < 1e-8
    w = [r["w"] for r in covariance.whiteners(blocks).orderBy("i").collect()]
    assert np.allclose(w[1], [-0.20412415, 1.02062073, 0]) and np.allclose(w[2], [-0.04371859, -0.30603012, 1.04924613])
    kept = covariance.masked_blocks(blocks, spark.createDataFrame([("a",), ("c",)], "gene string")).orderBy("i").collect()
    assert [(r["gene"], r["i"], list(r["r"])) for r in kept] == [("a", 0, []), ("c", 1, [0.1])]
    with pytest.raises(Exception, match="more correlations"):
        covariance.block_rows(raw.withColumn("r", F.array(F.lit(0.1)))).collect()


def test_contiguity(spark):
    one = spark.createDataFrame(list(enumerate("1122")), "y_idx long, chr string")
    two = spark.createDataFrame(list(enumerate("121")), "y_idx long, chr string")
    assert covariance.contiguous(one).first()["contiguous"] and not covariance.contiguous(two).first()["contiguous"]


def test_policies_and_chunks(spark):
    spine = spark.createDataFrame([(0, "g1"), (1, "g2"), (2, "g3")], "row_idx long, gene string")
    f = spark.createDataFrame([("g1", 1.0), ("g3", 3.0), ("g9", 100.0)], "id string, f double")
    joined = munge.on_spine(spine, [f])
    with pytest.raises(ValueError):
        munge.impute(joined, "raise")
    for policy, want in (("ignore", None), ("zero", 0.0), ("mean", 2.0)):
        assert [r[1] for r in rows(munge.impute(joined, policy).select("row_idx", "x"), "row_idx")] == [[1.0], [want], [3.0]]
    with pytest.raises(ValueError):
        munge.feature_names([f, f])
    # pieces that end and begin within chunks, a NaN, a gene that only one file has, a column of nothing but nulls
    a = spark.createDataFrame([("g1", 1.0, float("nan"), 3.0), ("g2", 4.0, 5.0, 6.0)], "id string, a double, b double, c double")
    b = spark.createDataFrame([("g3", 7.0, 8.0, None), ("g1", 9.0, 10.0, None)], "`a gene` string, d double, `e.1` double, g double")
    got = {(r["chunk_id"], r["gene"]): r["x"] for r in munge.on_spine(spine, [a, b], 4).collect()}
    assert got == {(0, "g1"): [1, None, 3, 9], (1, "g1"): [10, None], (0, "g2"): [4, 5, 6, None], (1, "g2"): [None, None], (0, "g3"): [None, None, None, 7], (1, "g3"): [8, None]}
    means = {(r["chunk_id"], r["gene"]): r["x"] for r in munge.impute(munge.on_spine(spine, [a, b], 4), "mean").collect()}
    assert means[0, "g3"] == [2.5, 5, 4.5, 7] and means[1, "g2"] == [9, None]
    assert not munge.repeated_genes(munge.pieces([a, b], 4)).count() and munge.repeated_genes(munge.pieces([a.union(a), b], 4)).count() == 2
    assert munge.on_spine(spine.where("false"), [a, b], 4).count() == 0
    for n, want in ((5, [2, 2, 1]), (4, [2, 2])):
        cols = spark.range(n).select(F.col("id").alias("col_idx"), F.lit("x").alias("feature"))
        assert [r[1] for r in rows(munge.layout(cols, 2).groupBy("chunk_id").count(), "chunk_id")] == want


def chunked(spark, x):
    return spark.createDataFrame([(0, str(i), [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id int, gene string, x array<double>")


def with_basis(spark, y, v=None):
    return spark.createDataFrame([(str(i), float(t), [1.0] if v is None else [float(a) for a in v[i]]) for i, t in enumerate(y)], "gene string, y double, v array<double>")


def test_marginal_and_near_constant(spark):
    m = association.marginal(chunked(spark, [[1, 5], [2, 5], [3, 5], [5, 5]]), with_basis(spark, [1, 3, 2, 6])).orderBy("pos").collect()
    assert np.allclose([m[0]["beta"], m[0]["se"], m[0]["pval"], m[0]["r2"]], [1.1428571428571428, 0.27105237087157535, 2.4826606338804658e-05, 0.8163265306122449])
    assert [m[1][c] for c in ("beta", "se", "pval", "r2")] == [None] * 4


def test_marginal_against_dense_algebra_in_blocks(spark):
    rng = np.random.default_rng(1)
    n, p = 40, 7
    x, y, v = rng.normal(size=(n, p)), rng.normal(size=n), np.column_stack([np.ones(n), rng.normal(size=n)])
    chunks = chunked(spark, x[:, :4]).union(spark.createDataFrame([(1, str(i), [float(a) for a in row]) for i, row in enumerate(x[:, 4:])], "chunk_id int, gene string, x array<double>"))
    got = association.marginal(chunks.repartition(5), with_basis(spark, y, v)).orderBy("chunk_id", "pos").collect()
    m = np.eye(n) - v @ np.linalg.inv(v.T @ v) @ v.T
    xr, yr = m @ x, m @ y
    beta = (xr * yr[:, None]).sum(0) / (xr * xr).sum(0)
    mse = ((yr[:, None] - xr * beta) ** 2).mean(0)
    assert np.allclose([r["beta"] for r in got], beta) and np.allclose([r["r2"] for r in got], 1 - mse / yr.var())
    assert np.allclose([r["pval"] for r in got], [math.erfc(abs(z) / 2**0.5) for z in beta / np.sqrt(mse / (xr * xr).sum(0))])


def test_stepwise_picks_each_feature_once(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 5))
    y = 3 * x[:, 3] + x[:, 1] + 0.1 * rng.normal(size=50)
    assert association.forward_stepwise(chunked(spark, x), with_basis(spark, y), 2) == [(0, 3), (0, 1)]


def test_ridge_constant():
    assert abs(covariance.ridge_constant(0.5, 8 / 3) - 1.55) < 1e-12
    assert abs(covariance.ridge_constant(-0.2, 0.5) - 0.25) < 1e-12


def training(spark, x, y):
    return spark.createDataFrame([(i, [float(a) for a in np.atleast_1d(r)], float(t)) for i, (r, t) in enumerate(zip(x, y))], "order long, x array<double>, y double")


def test_ridge_leave_one_out(spark):
    df = training(spark, [1, 2, 3], [1, 2, 2])
    f = fit.ridge(df)
    x, y = np.array([1.0, 2, 3]), np.array([1.0, 2, 2])
    score = {a: -np.mean([(y[i] - x[i] * (x @ y - x[i] * y[i]) / (x @ x - x[i] ** 2 + a)) ** 2 for i in range(3)]) for a in alphas()}
    assert abs(score[0.01] + 0.4677559212) < 1e-9 and abs(score[1.0] + 0.2868527576) < 1e-9
    best = max(score, key=score.get)
    assert float(f.meta["SELECTED_CV_ALPHA"]) == best and abs(float(f.meta["BEST_CV_SCORE"]) - score[best]) < 1e-12


def test_lasso_is_optimal_and_linreg_is_least_norm(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    y = x @ np.array([2.0, 0, 0, -1, 0, 0]) + 0.1 * rng.normal(size=60)
    df = training(spark, x, y)
    f = fit.lasso(df)
    g = x.T @ (y - x @ f.coef) / 60
    a = float(f.meta["SELECTED_CV_ALPHA"])
    assert np.all(np.abs(g) <= a + 1e-3) and np.allclose(g[f.coef != 0], a * np.sign(f.coef[f.coef != 0]), atol=1e-3)
    assert np.allclose(fit.linreg(df).coef, np.linalg.lstsq(x, y, rcond=None)[0])
    wide = x[:4]
    assert np.allclose(fit.linreg(training(spark, wide, y[:4])).coef, np.linalg.pinv(wide) @ y[:4])
    with pytest.raises(ValueError):
        fit.fit(df, "forest")


def test_gram_of_more_columns_than_4000(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(24, 4100)), rng.normal(size=24)
    xx, xy, yy, n = fit.gram(training(spark, x, y).coalesce(2))[0]
    assert np.allclose(xx, x.T @ x) and np.allclose(xy, x.T @ y) and abs(yy - y @ y) < 1e-9 and n == 24
    parts = fit.gram(training(spark, x[:, :300], y).withColumn("half", (F.col("order") / 12).cast("int")), "half")
    assert sorted(parts) == [0, 1] and all(np.allclose(parts[k][0], x[12 * k : 12 * k + 12, :300].T @ x[12 * k : 12 * k + 12, :300]) and parts[k][3] == 12 for k in parts)


def test_selection(spark):
    m = spark.createDataFrame([("a", 0, 0.01, 6.6), ("b", 1, 0.05, 3.8), ("c", 2, 0.04, 4.2), ("d", 3, None, None)], "feature string, col_idx long, pval double, z2 double")
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "feature string")
    got = select.select_features(m, 0.05, 1, names("b", "d", "zzz"))
    assert [r[0] for r in rows(got.where("selected").select("feature"), "feature")] == ["a", "b"]
    with pytest.raises(ValueError):
        select.select_features(m, only=names("a", "nope"))


def test_projection_and_intercept_rule(spark):
    rng = np.random.default_rng(4)
    c, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    target = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(y)], "gene string, y double")
    cov = spark.createDataFrame([(str(i), [float(a) for a in r]) for i, r in enumerate(c)], "gene string, c array<double>")
    got = {r["gene"]: r["y"] for r in project.project_out(target, cov, target.where("gene < '2'")).collect()}
    on = np.array([str(i) < "2" for i in range(30)])
    v = np.column_stack([c, np.ones(30)])
    want = y - v @ np.linalg.lstsq(v[on], y[on], rcond=None)[0]
    assert np.allclose([got[str(i)] for i in range(30)], want)
    flat = cov.select("gene", F.array(F.col("c")[0], F.lit(2.0)).alias("c"))
    assert project.with_intercept(flat).select(F.size("c")).first()[0] == 2


def test_prediction_and_pick(spark):
    chunks = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "a", [3.0]), (0, "b", [0.5, 1.0]), (1, "b", [4.0])], "chunk_id int, gene string, x array<double>")
    beta = spark.createDataFrame([(0, 1, 2.0), (1, 0, -1.0)], "chunk_id int, pos int, beta double")
    assert rows(predict.predict(chunks, beta), "gene") == [("a", 1.0), ("b", -2.0)]
    layout = spark.createDataFrame([(1, 0, 2), (0, 1, 1)], "chunk_id int, pos int, col_idx long")
    assert rows(predict.pick(chunks, layout), "gene") == [("a", [2.0, 3.0]), ("b", [1.0, 4.0])]


def test_erfc_of_arrays():
    x = np.concatenate([np.linspace(0, 6, 2001), [1e-300, 1.9999999, 2.0, 12.0, 26.0, 60.0, np.inf]])
    want = np.array([math.erfc(v) for v in x])
    assert np.all(np.abs(erfc(x) - want) <= 2e-13 * want + 1e-300)


def test_a_gene_without_features_is_an_error(spark):
    with pytest.raises(ValueError, match="lack features"):
        association.marginal(chunked(spark, [[1.0], [2.0], [4.0]]), with_basis(spark, [1, 2, 3, 4]))


def test_a_negative_eigenvalue_raises_the_diagonal(spark):
    raw = spark.createDataFrame([(0, "a", "1", []), (1, "b", "1", [1.5])], "y_idx long, gene string, chr string, r array<double>")
    target = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "gene string, y double")
    blocks = covariance.block_rows(raw)
    added = covariance.regularisation(blocks, target)
    assert abs(added - 0.55) < 1e-9
    w = np.array([r["w"] for r in covariance.whiteners(blocks, added).orderBy("i").collect()])
    assert np.allclose(w @ np.array([[1.55, 1.5], [1.5, 1.55]]) @ w.T, np.eye(2))


def test_chi2_tail(spark):
    got = spark.createDataFrame([(3.841458820694124,), (0.0,), (None,)], "z double").select(chi2_sf1("z")).collect()
    assert abs(got[0][0] - 0.05) < 1e-15 and got[1][0] == 1.0 and got[2][0] is None


def stepwise(x, y, v, steps):
    """The definition: at every step all columns are projected anew."""
    chosen = []
    for _ in range(steps):
        q = np.linalg.qr(np.column_stack([v, x[:, chosen]]))[0]
        xr, yr = x - q @ (q.T @ x), y - q @ (q.T @ y)
        z = np.array([(a @ yr) ** 2 / (a @ a) / (yr @ yr - (a @ yr) ** 2 / (a @ a)) if a @ a > 1e-8 and j not in chosen else -1 for j, a in enumerate(xr.T)])
        chosen.append(int(np.argmax(z)))
    return chosen


@pytest.mark.parametrize("whitened", [False, True])
def test_ten_steps(spark, whitened):
    """Equal picks for ten steps, with nearly and wholly dependent columns, in two chunks, with and without an error covariance."""
    rng = np.random.default_rng(11)
    n = 80
    x = rng.normal(size=(n, 30))
    x[:, 7], x[:, 8], x[:, 9] = x[:, 3] + 1e-3 * x[:, 7], x[:, 3], 5.0
    y = x[:, :14] @ np.linspace(3, 0.2, 14) + 0.3 * rng.normal(size=n)
    v = np.column_stack([np.ones(n), rng.normal(size=n)])
    if whitened:
        w = np.linalg.inv(np.linalg.cholesky(0.4 ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))))
        x, y, v = w @ x, w @ y, w @ v
    chunks = spark.createDataFrame([(c, str(i), [float(a) for a in row]) for c, part in enumerate((x[:, :20], x[:, 20:])) for i, row in enumerate(part)], "chunk_id int, gene string, x array<double>").repartition(4)
    got = association.forward_stepwise(chunks, with_basis(spark, y, v), 10)
    assert [20 * c + p for c, p in got] == stepwise(x, y, v, 10)
    with pytest.raises(ValueError, match="fewer usable"):
        association.forward_stepwise(chunks.withColumn("x", F.slice("x", 1, 2)), with_basis(spark, y, v), 5)


def test_one_pass_keeps_nearly_constant_columns(spark):
    """Values of 10^7 that vary by 1, over many tasks: sums of squares less squares of sums would have nothing left."""
    rng = np.random.default_rng(12)
    x = 1e7 + rng.normal(size=(300, 3))
    y = x[:, 0] - 1e7 + rng.normal(size=300)
    got = association.marginal(chunked(spark, x).repartition(7), with_basis(spark, y)).orderBy("pos").collect()
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose([r["beta"] for r in got], (xc * yc[:, None]).sum(0) / (xc * xc).sum(0), rtol=1e-6)
    with pytest.raises(Exception, match="linearly dependent"):
        association.marginal(chunked(spark, x), with_basis(spark, y, np.ones((300, 2))))

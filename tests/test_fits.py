"""Fits of wide and of nearly collinear matrices, and the products that they are made of, against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions.stats import alphas
from varve.operators import fit, orthogonal


def training(spark, x, y, parts=3):
    return spark.createDataFrame([(i, [float(a) for a in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "order long, x array<double>, y double").repartition(parts)


def loo(x, y):
    """Scores and coefficients of all penalties, from the inverse of each regularised kernel."""
    out = []
    for a in alphas():
        g = np.linalg.inv(x @ x.T + a * np.eye(len(x)))
        out.append((-((g @ y / np.diag(g)) ** 2).mean(), x.T @ (g @ y)))
    return out


@pytest.mark.parametrize("n, p", [(60, 3000), (40, 41), (40, 40), (90, 12), (7, 1)])
def test_ridge(spark, n, p):
    rng = np.random.default_rng(n + p)
    x = rng.normal(size=(n, p))
    y = x[:, : min(3, p)].sum(1) + rng.normal(size=n)
    got, want = fit.ridge(training(spark, x, y)), loo(x, y)
    best = int(np.argmax([s for s, _ in want]))
    assert got.meta["SELECTED_CV_ALPHA"] == repr(float(alphas()[best]))
    assert abs(float(got.meta["BEST_CV_SCORE"]) - want[best][0]) < 1e-6 * abs(want[best][0]) and np.allclose(got.coef, want[best][1], atol=1e-8)


def test_dual_and_primal_fits_are_one(spark):
    """On either side of p = n the two ways meet: a column of nothing changes no fit."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(30, 30)), rng.normal(size=30)
    wide = np.hstack([x, np.zeros((30, 1))])
    for one, other in ((fit.ridge(training(spark, x, y)), fit.ridge(training(spark, wide, y))), (fit.linreg(training(spark, x, y)), fit.linreg(training(spark, wide, y)))):
        assert one.meta.get("SELECTED_CV_ALPHA") == other.meta.get("SELECTED_CV_ALPHA") and np.allclose(one.coef, other.coef[:30], rtol=1e-5, atol=1e-7) and abs(other.coef[30]) < 1e-12


def test_nearly_collinear_columns_keep_digits(spark):
    """Condition 10^9: normal equations would leave nothing."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4))
    x[:, 3] = x[:, 2] + 1e-9 * x[:, 3]
    want = np.array([1.0, -2.0, 3.0, 0.5])
    got = fit.linreg(training(spark, x, x @ want, 6)).coef
    assert np.allclose(got[:2], want[:2], rtol=1e-9) and np.allclose(got, want, rtol=1e-5)
    assert not np.allclose(np.linalg.pinv(x.T @ x, hermitian=True) @ (x.T @ (x @ want)), want, rtol=1e-2)


def test_linreg_of_rank_one(spark):
    x = np.outer(np.arange(1.0, 9), [1, 2, 3])
    y = np.arange(8.0)
    assert np.allclose(fit.linreg(training(spark, x, y)).coef, np.linalg.pinv(x) @ y)
    with pytest.raises(ValueError, match="no training rows"):
        fit.linreg(training(spark, x, y).where("false"))


def test_products(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(70, 100))
    df = training(spark, x, np.zeros(70)).withColumn("id", F.col("order") * 3)
    w = rng.normal(size=(70, 2))
    assert np.allclose(orthogonal.column_sums(df, np.arange(70) * 3, w, 100), x.T @ w)
    assert np.allclose(orthogonal.column_sums(df, np.arange(35) * 6, w[::2], 100), x[::2].T @ w[::2])
    for side, chunk, held in ((512, 32 << 20, 128 << 20), (16, 8 * 70 * 16, 8 * 16 * 16 * 3)):
        monkeypatch.setattr(orthogonal, "SIDE", side), monkeypatch.setattr(orthogonal, "CHUNK_BYTES", chunk), monkeypatch.setattr(orthogonal, "HELD", held)
        assert np.allclose(orthogonal.kernel(df, 70), x @ x.T)
    r = orthogonal.r_factor(df.select(F.slice("x", 1, 20).alias("z")))
    assert r.shape == (20, 20) and np.allclose(r.T @ r, x[:, :20].T @ x[:, :20])


def optimal(x, y, b, alpha):
    g = x.T @ (y - x @ b) / len(y)
    return np.abs(g).max() <= alpha * 1.01 + 1e-9 and np.allclose(g[b != 0], alpha * np.sign(b[b != 0]), rtol=1e-2)


def test_lasso_by_working_set(spark, monkeypatch):
    """Wide data: the conditions hold over all columns; and the sets' way and the whole way give one path."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 1500))
    y = x[:, 5] * 2 - x[:, 900] + 0.5 * x[:, 1400] + 0.3 * rng.normal(size=120)
    got = fit.lasso(training(spark, x, y))
    assert optimal(x, y, got.coef, float(got.meta["SELECTED_CV_ALPHA"])) and {5, 900, 1400} <= set(np.flatnonzero(got.coef).tolist())
    small = x[:, :40].copy()
    small[:, 20] = y + rng.normal(size=120)
    whole = fit.lasso(training(spark, small, y))
    monkeypatch.setattr(fit, "WHOLE", 10)
    sets = fit.lasso(training(spark, small, y))
    assert sets.meta["SELECTED_CV_ALPHA"] == whole.meta["SELECTED_CV_ALPHA"] and np.allclose(sets.coef, whole.coef, atol=2e-3)
    assert abs(float(sets.meta["BEST_CV_SCORE"]) - float(whole.meta["BEST_CV_SCORE"])) < 1e-3
    nothing = fit.lasso(training(spark, small, np.zeros(120)))
    assert not nothing.coef.any()

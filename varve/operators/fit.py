"""Ridge with leave-one-out, lasso with five folds, and least squares.

Ridge and least squares go by the R factor of the columns, or, where there are
more columns than rows, by the kernel of the rows; lasso by Gram matrices of all
columns, or of a working set where they are many. So what reaches the driver is
min(n, p)^2 numbers, or those of the set. No intercept is fitted: columns and
target come projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import alphas
from ..tables import dropped, kept
from .orthogonal import column_sums, kernel, lists, matrix, r_factor, weighed_sums

METHODS = ("ridge", "lasso", "linreg")
#: Numbers of a line of a Gram matrix that are sent in one row.
TILE = 128
#: Columns up to which lasso takes the Gram matrices of all of them.
WHOLE = 1024


@dataclass
class Fit:
    coef: np.ndarray
    meta: dict[str, str]


def gram(rows: DataFrame, by: str | None = None) -> dict:
    """X'X, X'y, y'y and the count of rows (x, y), for each value of ``by`` (None: of all under 0).

    Tasks send the upper half of their sums in tiles, a row for TILE numbers of
    a line, which are added tile by tile as they stream in after a shuffle.
    """
    schema = "key long, i int, j int, g array<double>"

    def frame(at: np.ndarray, g: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": at[:, 0], "i": at[:, 1].astype(np.int32), "j": at[:, 2].astype(np.int32), "g": list(g)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for key, own in pdf.groupby("key"):
                z = np.column_stack([np.stack(list(own["x"])), own["y"].to_numpy(), np.ones(len(own))])
                g = z.T @ z
                if key in total:
                    total[key] += g
                else:
                    total[key] = g
        for key, g in total.items():
            tiles = -(-len(g) // TILE)
            for i in range(0, len(g), TILE):
                lines = np.zeros((min(TILE, len(g) - i), tiles * TILE - i))
                lines[:, : len(g) - i] = g[i : i + TILE, i:]
                at = np.array([(key, i + k, j) for k in range(len(lines)) for j in range(i, len(g), TILE)], np.int64)
                yield frame(at, lines.reshape(-1, TILE))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last tile, which may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            at = pdf[["key", "i", "j"]].to_numpy(np.int64)
            first = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1)
            at, g = at[first], np.add.reduceat(np.stack(list(pdf["g"])), first, axis=0)
            if held is not None:
                if (held[0] == at[:1]).all():
                    g[0] += held[1][0]
                else:
                    yield frame(*held)
            held = at[-1:], g[-1:]
            if len(at) > 1:
                yield frame(at[:-1], g[:-1])
        if held is not None:
            yield frame(*held)

    keyed = rows.select("x", "y", (F.col(by) if by else F.lit(0)).cast("long").alias("key"))
    place = ["key", "i", "j"]
    sums = keyed.mapInPandas(run, schema).repartition(*place).sortWithinPartitions(*place).mapInPandas(add, schema).toArrow()
    if not sums.num_rows:
        raise ValueError("there are no training rows")
    width = pc.max(sums.column("i")).as_py() + 1
    out: dict[int, np.ndarray] = {}
    for batch in sums.to_batches():
        key, i, j = (batch.column(c).to_numpy() for c in place)
        g = batch.column("g").flatten().to_numpy().reshape(-1, TILE)
        for k, line, at, tile in zip(key.tolist(), i.tolist(), j.tolist(), g, strict=True):
            own = out.setdefault(k, np.zeros((width, width)))
            at, tile = max(at, line), tile[max(0, line - at) : width - at]
            own[line, at : at + len(tile)] = own[at : at + len(tile), line] = tile
    return {k: (g[:-2, :-2], g[:-2, -2], float(g[-2, -2]), int(g[-1, -1])) for k, g in sorted(out.items())}


def _decomposed(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s, v of r = u s v'. Where singular values don't converge, by the eigenvalues of r'r."""
    try:
        u, s, vt = np.linalg.svd(r, full_matrices=False)
        return u, s, vt.T
    except np.linalg.LinAlgError:
        low, v = np.linalg.eigh(r.T @ r)
        s = np.sqrt(np.maximum(low, 0.0))
        return (r @ v) / np.where(s > 0, s, 1.0), s, v


def _identified(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (id, x, y) written down, so that ids stay, and the sorted ids with their y: two numbers a row."""
    own = kept(rows.select(F.monotonically_increasing_id().alias("id"), "x", "y"), "training")
    pairs = own.select("id", "y").toArrow()
    ids, y = pairs.column("id").to_numpy(), pairs.column("y").to_numpy()
    order = np.argsort(ids)
    return own, ids[order], y[order]


def _shape(rows: DataFrame) -> tuple[int, int]:
    found = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not found[0]:
        raise ValueError("there are no training rows")
    return found[0], found[1]


def ridge(rows: DataFrame) -> Fit:
    """The penalty with the best leave-one-out error of the grid, the first among equals; the score is the negative mean squared error.

    With more columns than rows by way of the kernel of the rows: the driver
    holds min(n, p)^2 numbers.
    """
    n, p = _shape(rows)
    grid = np.array(alphas())
    if p > n:
        own, ids, y = _identified(rows)
        low, q = np.linalg.eigh(kernel(own, n))
        shrink = 1.0 / (np.maximum(low, 0.0)[None, :] + grid[:, None])
        dual = (shrink * (q.T @ y)) @ q.T  # a line for each penalty
        miss = dual / (shrink @ (q * q).T)  # leave-one-out residuals
        scores = -(miss * miss).mean(axis=1)
        best = int(np.argmax(scores))
        coef = column_sums(own, ids, dual[best][:, None], p)[:, 0]
        dropped(own)
    else:
        u, s, q, toward = _triangular(rows, p)
        shrink = 1.0 / (s[None, :] ** 2 + grid[:, None])
        rotated = s * (u.T @ toward)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    z = np.stack(list(pdf["x"])) @ q
                    lever = (z * z) @ shrink.T
                    miss = (pdf["y"].to_numpy()[:, None] - z @ (shrink * rotated).T) / np.maximum(1 - lever, 1e-12)
                    yield pd.DataFrame({"s": [(miss * miss).sum(0)]})

        sums = rows.select("x", "y").mapInPandas(run, "s array<double>").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(len(grid))]).alias("s")).first()["s"]
        scores = -np.array(sums) / n
        best = int(np.argmax(scores))
        coef = q @ (shrink[best] * rotated)
    return Fit(coef, {"METHOD": "RidgeCV", "SELECTED_CV_ALPHA": repr(float(grid[best])), "BEST_CV_SCORE": repr(float(scores[best]))})


def _triangular(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The decomposition u, s, v of the R factor of x, and what stands for y beside it."""
    r = r_factor(rows.select(F.concat("x", F.array("y")).alias("z")))[:p]
    return *_decomposed(r[:, :p]), r[:, p]


def descend(xx: np.ndarray, xy: np.ndarray, n: int, alpha: float, start: np.ndarray, seed: int, rounds: int = 1000, tolerance: float = 1e-4) -> np.ndarray:
    """Coordinate descent in random order on (1 / 2n) |y - Xb|^2 + alpha |b|, from the Gram matrix."""
    rng = np.random.default_rng(seed)
    b, diag = start.copy(), np.diag(xx)
    g = xy - xx @ b
    for _ in range(rounds):
        most = 0.0
        for j in rng.permutation(len(b)):
            if diag[j] <= 0:
                continue
            z = g[j] + diag[j] * b[j]
            new = np.sign(z) * max(0.0, abs(z) - n * alpha) / diag[j]
            if new != b[j]:
                g -= xx[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most <= tolerance * max(1e-12, np.abs(b).max()):
            break
    return b


def lasso(rows: DataFrame, seed: int = 42, folds: int = 5) -> Fit:
    """rows (x, y, order): contiguous folds by order; the score is the positive mean squared error at the chosen penalty.

    Up to WHOLE columns the folds go down the penalties on Gram matrices of
    all columns, a task for each; beyond, on those of a working set, see
    _by_working_set().
    """
    total, p = _shape(rows)
    edges = np.cumsum([total // folds + (i < total % folds) for i in range(folds)]).tolist()
    fold = F.lit(folds - 1)
    for i in range(folds - 2, -1, -1):
        fold = F.when(F.col("order") < edges[i], i).otherwise(fold)
    grid = sorted(alphas(), reverse=True)
    split = rows.select("x", "y", fold.cast("int").alias("fold"))
    errors, coefs = _on_whole_grams(split, grid, total, seed) if p <= WHOLE else _by_working_set(split, grid, min(folds, total), total, p, seed)
    best = int(np.argmin(errors.mean(axis=1)))
    return Fit(coefs(best), {"METHOD": "LassoCV", "SELECTED_CV_ALPHA": repr(grid[best]), "BEST_CV_SCORE": repr(float(errors[best].mean()))})


def _on_whole_grams(rows: DataFrame, grid: list[float], total: int, seed: int):
    """Errors (penalties x folds), and the coefficients at a penalty of the grid. What is sent are WHOLE^2 numbers a fold at most."""
    parts = gram(rows, "fold")
    xx, xy = sum(p[0] for p in parts.values()), sum(p[1] for p in parts.values())
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((xx, xy, list(parts.values())))

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"].tolist():
                xx, xy, folds = sent.value
                own = folds[k]
                rest, toward = xx - own[0], xy - own[1]
                b, found = np.zeros(len(xy)), []
                for alpha in grid:
                    b = descend(rest, toward, total - own[3], alpha, b, seed)
                    found.append(_held_out(own, b))
                yield pd.DataFrame({"k": [k], "errors": [found]})

    errors = np.zeros((len(grid), len(parts)))
    for r in spark.range(0, len(parts), 1, len(parts)).mapInPandas(path, "k long, errors array<double>").collect():
        errors[:, r["k"]] = r["errors"]
    sent.destroy()

    def coefs(best: int) -> np.ndarray:
        b = np.zeros(len(xy))
        for alpha in grid[: best + 1]:
            b = descend(xx, xy, total, alpha, b, seed)
        return b

    return errors, coefs


def _held_out(fold: tuple, b: np.ndarray) -> float:
    """The mean squared error of b in a fold."""
    return (fold[2] - 2 * b @ fold[1] + b @ fold[0] @ b) / fold[3]


def _descended(spark: SparkSession, problems: list[tuple], alpha: float, seed: int) -> list[np.ndarray]:
    """descend() for each of (xx, xy, n, start), a task each."""
    sent = pa.table({"k": pa.array(range(len(problems)), pa.int32()), "n": pa.array([p[2] for p in problems], pa.int64()), **{c: pa.array([np.ascontiguousarray(p[i]).tobytes() for p in problems], pa.binary()) for c, i in (("xx", 0), ("xy", 1), ("b", 3))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xx, xy, b = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in ("xx", "xy", "b"))
                out = descend(xx.reshape(len(b), -1), xy, batch.column("n")[i].as_py(), alpha, b, seed, tolerance=1e-6)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, 1), lists(out[None])], names=["k", "b"])

    found = spark.createDataFrame(sent).repartition(len(problems), "k").mapInArrow(run, "k int, b array<double>").collect()
    return [np.array(r["b"]) for r in sorted(found, key=lambda r: r["k"])]


def _by_working_set(rows: DataFrame, grid: list[float], folds: int, total: int, p: int, seed: int, slack: float = 1e-3):
    """As _on_whole_grams(), for any number of columns.

    All folds and the whole fit share one working set of columns. At each
    penalty they are solved on its Gram matrices; then one pass over the rows
    makes the residuals and their products with all columns, and the columns
    that break the optimality conditions of any fit, by more than ``slack`` of
    the penalty, join the set, worst first, till none does. So the result is
    optimal over all columns, and what is held is the set's numbers squared.
    """
    own = kept(rows, "folds")
    spark, fits = rows.sparkSession, folds + 1

    def products(columns: np.ndarray, b: np.ndarray) -> np.ndarray:
        """X'r of each fit's residuals over the rows that it is fitted on."""

        def residuals(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
            on = batch.column("fold").to_numpy()[:, None] != np.arange(fits)  # the last fit is on all
            return (batch.column("y").to_numpy()[:, None] - x[:, columns] @ b) * on

        return weighed_sums(own, residuals, p, fits)

    def grams(columns: np.ndarray) -> dict:
        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([lists(matrix(batch.column("x"))[:, columns]), batch.column("y"), batch.column("fold")], names=["x", "y", "fold"])

        return gram(own.mapInArrow(picked, "x array<double>, y double, fold int"), "fold")

    sizes = {r["fold"]: (r["n"], r["yy"]) for r in own.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy")).collect()}
    n = np.array([total - sizes[f][0] for f in range(folds)] + [total])
    columns, b = np.zeros(0, np.int64), np.zeros((0, fits))
    slope = products(columns, b)  # of the fits as they stand
    parts, problems = {}, []
    errors, solutions = np.zeros((len(grid), folds)), []
    for a, alpha in enumerate(grid):
        while True:
            over = (np.abs(slope) / n).max(axis=1)
            over[columns] = 0.0
            worst = np.argsort(-over, kind="stable")[: max(256, len(columns))]
            worst = worst[over[worst] > alpha * (1 + slack)]
            if len(worst):
                columns, b = np.append(columns, worst), np.vstack([b, np.zeros((len(worst), fits))])
                parts = grams(columns)
                xx, xy = sum(g[0] for g in parts.values()), sum(g[1] for g in parts.values())
                problems = [(xx - parts[f][0], xy - parts[f][1], n[f]) if f < folds else (xx, xy, total) for f in range(fits)]
            if not len(columns):
                break
            b = np.column_stack(_descended(spark, [(*q, b[:, f]) for f, q in enumerate(problems)], alpha, seed))
            slope = products(columns, b)
            if not ((np.abs(np.delete(slope, columns, axis=0)) / n).max(initial=0) > alpha * (1 + slack)):
                break
        errors[a] = [_held_out(parts[f], b[:, f]) if len(columns) else sizes[f][1] / sizes[f][0] for f in range(folds)]
        solutions.append((columns, b[:, -1].copy()))
    dropped(own)

    def coefs(best: int) -> np.ndarray:
        out = np.zeros(p)
        at, values = solutions[best]
        out[at] = values
        return out

    return errors, coefs


def linreg(rows: DataFrame) -> Fit:
    """Least squares of the smallest norm: from the R factor, or, with more columns than rows, from the kernel of the rows."""
    n, p = _shape(rows)
    if p > n:
        own, ids, y = _identified(rows)
        coef = column_sums(own, ids, (np.linalg.pinv(kernel(own, n), hermitian=True) @ y)[:, None], p)[:, 0]
        dropped(own)
    else:
        u, s, v, toward = _triangular(rows, p)
        on = s > np.finfo(float).eps * max(n, p) * s.max(initial=0)
        coef = v[:, on] @ ((u.T @ toward)[on] / s[on])
    return Fit(coef, {"METHOD": "LinearRegression"})


def fit(rows: DataFrame, method: str = "ridge", seed: int = 42) -> Fit:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    return {"ridge": ridge, "lasso": lambda r: lasso(r, seed), "linreg": linreg}[method](rows)

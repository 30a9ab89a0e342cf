"""Marginal association of each feature with the target, and forward stepwise selection.

Values lie in chunks (chunk_id, gene, x), x being a gene's values of the
chunk's columns. Basis rows (gene, y, v) have the target and the vectors that
are projected out, v[0] usually the intercept. With an error covariance both
come whitened; the formulas are the same.

One pass: a task turns its rows by an orthogonal matrix that makes the basis
vectors triangular. What is left below them is residual for good, so its sums
of squares and products are added up; the few rows beside the triangle go on,
and are turned again with those of other tasks. So no sum is taken from another
one, and nearly constant columns don't cancel. Only these rows and moments are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf1, near_zero
from ..tables import dropped, kept
from .orthogonal import lists, matrix, r_factor
from .predict import pick

#: A basis up to this size is broadcast, at ROW_BYTES a gene besides its vectors; a larger one is joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 96
#: Of its first residual sum of squares, what a column has to keep in stepwise selection; less is rounding.
LEAST_LEFT = 1e-12


class Moments:
    """Of rows (v, z), z being a chunk's columns with the target last: the triangle and what stands beside it, and the residuals' sums."""

    def __init__(self, k: int, width: int):
        self.r, self.c = np.zeros((0, k)), np.zeros((0, width))
        self.squares, self.products = np.zeros(width), np.zeros(width)  # products with the target
        self.sums, self.n = np.zeros(k + 1), 0  # of v and of the target

    def turn(self, v: np.ndarray, z: np.ndarray) -> None:
        v, z = np.vstack([self.r, v]), np.vstack([self.c, z])
        q, self.r = np.linalg.qr(v)
        self.c = q.T @ z
        rest = z - q @ self.c
        self.squares += (rest * rest).sum(0)
        self.products += rest.T @ rest[:, -1]

    def add(self, v: np.ndarray, z: np.ndarray) -> None:
        self.turn(v, z)
        self.sums += np.append(v.sum(0), z[:, -1].sum())
        self.n += len(v)

    def merge(self, r: np.ndarray, c: np.ndarray, squares: np.ndarray, products: np.ndarray, sums: np.ndarray, n: int) -> None:
        self.turn(r, c)
        self.squares += squares
        self.products += products
        self.sums += sums
        self.n += n

    def mean(self) -> float:
        """Of the target's residuals."""
        size = np.abs(np.diag(self.r))
        if len(self.r) < self.r.shape[1] or size.min() <= 1e-13 * size.max():
            raise ValueError("the basis vectors are linearly dependent")
        return (self.sums[-1] - self.sums[:-1] @ np.linalg.solve(self.r, self.c[:, -1])) / self.n


_PARTS = "chunk_id int, r array<double>, c array<double>, squares array<double>, products array<double>, sums array<double>, n long"


def _basis_joined(chunks: DataFrame, basis: DataFrame, n: int, k: int) -> DataFrame:
    return chunks.select("chunk_id", "gene", "x").join(F.broadcast(basis) if n * (8 * k + ROW_BYTES) <= BROADCAST_BYTES else basis, "gene")


def _by_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    ids = batch.column("chunk_id").to_numpy()
    for chunk in np.unique(ids).tolist():
        on = ids == chunk
        yield chunk, batch if on.all() else batch.filter(pa.array(on))


def residual_moments(chunks: DataFrame, basis: DataFrame, n: int, k: int) -> DataFrame:
    """(chunk_id, pos, ssx, sxy, ssy, mean, found): residual sums of each column and of the target, the mean of the target's residuals, and the rows found. One pass over the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for batch in batches:
            for chunk, own in _by_chunk(batch):
                x, v = matrix(own.column("x")), matrix(own.column("v"))
                if chunk not in total:
                    total[chunk] = Moments(v.shape[1], x.shape[1] + 1)
                total[chunk].add(v, np.column_stack([x, own.column("y").to_numpy()]))
        for chunk, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *(lists(a.reshape(1, -1)) for a in (m.r, m.c, m.squares, m.products, m.sums)), pa.array([m.n])], names=["chunk_id", "r", "c", "squares", "products", "sums", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, m = None, None

        def out() -> pa.RecordBatch:
            p, mean = len(m.squares) - 1, m.mean()
            each = lambda v, kind=None: pa.array(np.full(p, v), kind)
            return pa.RecordBatch.from_arrays([each(last, pa.int32()), pa.array(np.arange(p, dtype=np.int32)), pa.array(m.squares[:-1]), pa.array(m.products[:-1]), each(m.squares[-1]), each(mean), each(m.n, pa.int64())], names=["chunk_id", "pos", "ssx", "sxy", "ssy", "mean", "found"])

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, n = batch.column("chunk_id")[i].as_py(), batch.column("n")[i].as_py()
                r, c, squares, products, sums = (batch.column(name)[i].values.to_numpy() for name in ("r", "c", "squares", "products", "sums"))
                if chunk != last:
                    if last is not None:
                        yield out()
                    last, m = chunk, Moments(len(sums) - 1, len(squares))
                m.merge(r.reshape(-1, len(sums) - 1), c.reshape(-1, len(squares)), squares, products, sums, n)
        if last is not None:
            yield out()

    parts = _basis_joined(chunks, basis.select("gene", "y", "v"), n, k).select("chunk_id", "x", "y", "v").mapInArrow(run, _PARTS)
    return parts.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(merged, "chunk_id int, pos int, ssx double, sxy double, ssy double, mean double, found long")


def checked_moments(chunks: DataFrame, basis: DataFrame) -> tuple[DataFrame, int, float, float]:
    """The moments as a table written down, the genes, and the target's residual sum of squares and variance.

    A gene of the basis without values, or with several rows of them, is an error.
    """
    basis = basis.persist()
    n, k = basis.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    table = kept(residual_moments(chunks, basis, n, k or 0), "moments")
    seen = table.agg(F.min("found"), F.max("found"), F.min_by(F.struct("ssy", "mean"), F.struct("chunk_id", "pos"))).first()
    if seen[0] is None or seen[0] < n:
        lacking = [r[0] for r in basis.join(chunks, "gene", "left_anti").select("gene").limit(5).collect()]
        raise ValueError(f"genes of the target lack features: {lacking}")
    if seen[1] > n:
        twice = [r[0] for r in chunks.join(basis.select("gene"), "gene").groupBy("chunk_id", "gene").count().where("count > 1").select("gene").distinct().limit(5).collect()]
        raise ValueError(f"genes have several rows of values: {twice}")
    basis.unpersist()
    left, mean = seen[2]
    return table, n, left, left / n - mean**2


def marginal(chunks: DataFrame, basis: DataFrame) -> DataFrame:
    """(chunk_id, pos, beta, se, z2, pval, r2, n) of every column; null where the column is nearly constant.

    A gene of the basis without values, or with several rows of them, is an
    error. The basis (a row for each gene) is sent to all tasks where it is
    small; the moments, a row for each column, are written down.
    """
    table, n, left, variance = checked_moments(chunks, basis)
    return statistics(table.select("chunk_id", "pos", "ssx", "sxy"), left, variance, n).select("chunk_id", "pos", "beta", "se", "z2", "pval", "r2", "n")


def statistics(sums: DataFrame, yy: float, variance: float, n: int) -> DataFrame:
    """beta, se, z2, pval and r2 from ssx and sxy; the error's divisor is n, the p-value that of a chi-squared with one degree."""
    ok = ~near_zero(F.col("ssx"))
    beta = F.when(ok, F.col("sxy") / F.when(ok, F.col("ssx")))
    error = F.greatest(F.lit(0.0), (F.lit(yy) - F.col("beta") * F.col("sxy")) / n)
    out = sums.withColumn("beta", beta).withColumn("mse", error).withColumn("se", F.when(ok, F.sqrt(F.col("mse") / F.when(ok, F.col("ssx")))))
    out = out.withColumn("z2", F.when(ok & (F.col("se") > 0), (F.col("beta") / F.when(F.col("se") > 0, F.col("se"))) ** 2).when(ok, F.lit(float("inf"))))
    return out.withColumn("pval", chi2_sf1("z2")).withColumn("r2", F.when(ok, 1 - F.col("mse") / F.lit(variance)) if variance else F.lit(None).cast("double")).withColumn("n", F.lit(n).cast("long"))


def marginal_sql(long: DataFrame) -> DataFrame:
    """The same for long rows (col_idx, x, y) and the intercept alone, with Spark's own regression aggregates."""
    per = long.groupBy("col_idx").agg(F.regr_slope("y", "x").alias("beta"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.count(F.lit(1)).alias("n"))
    ok = ~near_zero(F.col("sxx"))
    se2 = (1 - F.col("r2")) * F.col("syy") / F.col("n") / F.when(ok, F.col("sxx"))
    return per.select("col_idx", F.when(ok, F.col("beta")).alias("beta"), F.when(ok, F.sqrt(se2)).alias("se"), F.when(ok, F.col("r2")).alias("r2"), F.when(ok & (se2 > 0), F.col("beta") ** 2 / F.when(se2 > 0, se2)).alias("z2"), "n")


def _products(chunks: DataFrame, weights: DataFrame, n: int) -> np.ndarray:
    """Inner products of every column with weights (gene, w), as (chunk_id, pos, t) lines in order; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, own in _by_chunk(batch):
                part = own.column("w").to_numpy() @ matrix(own.column("x"))
                total[chunk] = total[chunk] + part if chunk in total else part
        for chunk, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), chunk, np.int32)), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(t)], names=["chunk_id", "pos", "t"])

    sums = _basis_joined(chunks, weights, n, 1).select("chunk_id", "x", "w").mapInArrow(run, "chunk_id int, pos int, t double").groupBy("chunk_id", "pos").agg(F.sum("t").alias("t"))
    return sums.toPandas().sort_values(["chunk_id", "pos"]).to_numpy()  # a line for each column


def forward_stepwise(chunks: DataFrame, basis: DataFrame, steps: int) -> list[tuple[int, int]]:
    """(chunk_id, pos) of the columns picked, one a step: the smallest p-value given those before, ties to the larger z2, then the first column.

    Residual sums of all columns are kept, two numbers each, and a step takes
    from them what the newly picked column explains: its part orthogonal to the
    basis becomes a basis vector, and one pass gives its product with every
    column. A column of which less than LEAST_LEFT is left counts as dependent.
    """
    table, n, syy, _ = checked_moments(chunks, basis)
    now = table.select("chunk_id", "pos", "ssx", "sxy").toPandas().sort_values(["chunk_id", "pos"])  # a line for each column
    dropped(table)
    places, ssx, sxy = now[["chunk_id", "pos"]].to_numpy(), now["ssx"].to_numpy(), now["sxy"].to_numpy()
    first, free, chosen = ssx.copy(), np.ones(len(ssx), bool), []
    scaled = np.linalg.inv(r_factor(basis.select(F.col("v").alias("z"))))
    turned = [sum((F.col("v")[i] * F.lit(float(w)) for i, w in enumerate(column)), F.lit(0.0)) for column in scaled.T]
    orthogonal = kept(basis.select("gene", "y", F.array(*turned).alias("q")), "basis")
    while True:
        usable = free & (np.abs(ssx) > 1e-8) & (ssx > LEAST_LEFT * first)
        if not usable.any():
            raise ValueError("there are fewer usable features than steps")
        explained = np.divide(sxy * sxy, ssx, out=np.zeros(len(ssx)), where=usable)
        error = np.maximum(0.0, (syy - explained) / n)
        z2 = np.where(usable, np.divide(explained, error, out=np.full(len(ssx), np.inf), where=error > 0), -1.0)
        best = int(np.argmax(z2))  # the first of the largest
        chosen.append((int(places[best, 0]), int(places[best, 1])))
        free[best] = False
        if len(chosen) == steps:
            dropped(orthogonal)
            return chosen
        spark, k = chunks.sparkSession, len(scaled) + len(chosen) - 1
        own = pick(chunks, spark.createDataFrame([(*chosen[-1], 0)], "chunk_id int, pos int, col_idx long"))
        rows = orthogonal.join(own, "gene").select("gene", "y", "q", F.col("x")[0].alias("x"))
        r = r_factor(rows.select(F.concat("q", F.array("x", "y")).alias("z")))
        part, size = np.linalg.solve(r[:k, :k], r[:k, k]), abs(r[k, k])
        toward = r[k, k + 1] * np.sign(r[k, k])
        rest = F.col("x") - sum((F.col("q")[i] * F.lit(float(a)) for i, a in enumerate(part)), F.lit(0.0))
        new = kept(rows.select("gene", "y", F.concat("q", F.array(rest / F.lit(float(size)))).alias("q")), "basis")
        dropped(orthogonal)
        orthogonal = new
        t = _products(chunks, orthogonal.select("gene", F.element_at("q", -1).alias("w")), n)[:, 2]
        ssx, sxy, syy = ssx - t * t, sxy - t * toward, syy - toward**2

"""Projection of covariates out of the target, and of a basis out of values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import near_zero
from ..tables import kept
from .orthogonal import lists, matrix, r_factor, weighed_sums


def with_intercept(covariates: DataFrame) -> DataFrame:
    """(gene, c) with a one appended, unless a column of all genes is constant already (variance within 1e-8 of 0)."""
    k = covariates.select(F.size("c")).first()[0]
    flat = covariates.agg(F.greatest(*[near_zero(F.var_pop(F.col("c")[i])).cast("int") for i in range(k)], F.lit(0))).first()[0]
    return covariates if flat else covariates.select("gene", F.concat("c", F.array(F.lit(1.0))).alias("c"))


def project_out(target: DataFrame, covariates: DataFrame, used: DataFrame, whitened: DataFrame | None = None) -> DataFrame:
    """(gene, y): the target less its fit on the covariates, of the smallest norm where they are dependent.

    The fit is over ``used`` genes, on ``whitened`` (gene, y, c) of them if an
    error covariance is given; residuals are of all genes and unwhitened. The
    covariates, a row for each gene, are written down once; the fit is from the
    R factor of covariates and target.
    """
    own = kept(covariates.select("gene", "c"), "covariates")
    k = own.agg(F.max(F.size("c"))).first()[0] or 0
    flat = own.agg(F.greatest(*[near_zero(F.var_pop(F.col("c")[i])).cast("int") for i in range(k)], F.lit(0))).first()[0]
    rows = target.join(own, "gene", "left")
    if rows.where("c is null").limit(1).count():
        raise ValueError("genes of the target lack covariates")
    terms = F.col("c") if flat else F.concat("c", F.array(F.lit(1.0)))
    width = k if flat else k + 1
    fitted = rows.join(used.select("gene"), "gene", "left_semi").select(F.concat(terms, F.array("y")).alias("z")) if whitened is None else whitened.select(F.concat(F.slice("c", 1, width), F.array("y")).alias("z"))
    r = r_factor(fitted)
    b = np.linalg.lstsq(r[:, :width], r[:, width], rcond=None)[0]
    return rows.select("gene", (F.col("y") - sum((F.lit(float(v)) * terms[i] for i, v in enumerate(b)), F.lit(0.0))).alias("y"))


def residual_values(values: DataFrame, basis: DataFrame) -> DataFrame:
    """(gene, x, y) less their fit on basis (gene, y, v): what a model is trained on. values: (gene, x).

    One pass sums the products with the basis, and a second takes the fit off.
    """
    rows = values.select("gene", "x").join(basis.select("gene", "y", "v"), "gene")
    first = rows.select(F.size("x"), F.size("v")).first()
    if first is None:
        return rows.select("gene", "x", "y")
    p, k = first
    turned = np.linalg.inv(r_factor(basis.select(F.col("v").alias("z"))))  # v times this is orthonormal

    def weights(batch: pa.RecordBatch, _: np.ndarray) -> np.ndarray:
        return matrix(batch.column("v")) @ turned

    coef = weighed_sums(rows.select(F.concat("x", F.array("y")).alias("x"), "v"), weights, p + 1, k).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([matrix(batch.column("x")), batch.column("y").to_numpy()]) - matrix(batch.column("v")) @ turned @ coef
                yield pa.RecordBatch.from_arrays([batch.column("gene"), lists(z[:, :p]), pa.array(np.ascontiguousarray(z[:, p]))], names=["gene", "x", "y"])

    return rows.mapInArrow(run, "gene string, x array<double>, y double")

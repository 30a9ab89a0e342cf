"""Scores of all genes, and the training rows of a fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(chunks: DataFrame, layout: DataFrame) -> DataFrame:
    """(gene, x): the columns in layout (chunk_id, pos, col_idx), in column order.

    Chunks without a column are pruned; of the others only the columns' values
    are carried on.
    """
    wanted: dict[int, list] = {}
    for r in layout.select("chunk_id", "pos", "col_idx").orderBy("col_idx").collect():  # the selected features
        wanted.setdefault(r["chunk_id"], []).append(r["pos"])
    parts = [chunks.where(F.col("chunk_id") == c).select("gene", F.lit(c).alias("chunk_id"), F.transform(F.array(*[F.lit(p) for p in pos]), lambda p: F.col("x")[p]).alias("x")) for c, pos in sorted(wanted.items())]
    if len(parts) == 1:
        return parts[0].select("gene", "x")
    rows = reduce(DataFrame.union, parts)
    return rows.groupBy("gene").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "x"))), lambda s: s["x"])).alias("x"))


def predict(chunks: DataFrame, coefs: DataFrame) -> DataFrame:
    """(gene, score): the raw values times coefficients (chunk_id, pos, beta), for every gene of the matrix. A gene with several rows of values is an error."""
    most = coefs.select("chunk_id").distinct().count()
    per = coefs.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "beta"))).alias("b"))
    own = chunks.join(F.broadcast(per), "chunk_id").select("gene", F.aggregate("b", F.lit(0.0), lambda s, c: s + F.col("x")[c["pos"]] * c["beta"]).alias("part"))
    once = F.count(F.lit(1)) <= most
    return own.groupBy("gene").agg(F.when(once, F.sum("part")).otherwise(F.raise_error(F.concat(F.lit("a gene has several rows of values: "), "gene"))).alias("score"))


def annotate(scores: DataFrame, target: DataFrame, masks: dict[str, DataFrame], projected: DataFrame | None = None) -> DataFrame:
    """Scores with Y, Y_proj where the target was projected, and a boolean for each mask (gene)."""
    out = scores.join(target.select("gene", F.col("y").alias("Y")), "gene", "left")
    if projected is not None:
        out = out.join(projected.select("gene", F.col("y").alias("Y_proj")), "gene", "left")
    for name, genes in masks.items():
        out = out.join(genes.select("gene", F.lit(True).alias(name)), "gene", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out

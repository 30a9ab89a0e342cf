"""Gene masks by chromosome and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_hla(chr_: Column, tss: Column) -> Column:
    """The HLA region: chromosome 6, 20 to 40 Mb, both ends included."""
    return (chr_ == "6") & tss.between(20e6, 40e6)


def gene_mask(target: DataFrame, annotation: DataFrame, chromosomes: list[str] | None, remove_hla: bool = True, name: str = "used") -> DataFrame:
    """``target`` with a boolean ``name``; genes that the annotation lacks are left out of the mask.

    chromosomes: None for all.
    """
    keep = F.lit(True) if chromosomes is None else F.col("chr").isin(*chromosomes)
    if remove_hla:
        keep = keep & ~is_hla(F.col("chr"), F.col("tss"))
    marked = annotation.select("gene", keep.alias(name))
    return target.join(marked, "gene", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def natural_order(chr_: Column) -> list[Column]:
    """Sort keys that put numbers by value, then other names."""
    return [chr_.try_cast("int").asc_nulls_last(), chr_.asc()]


def checked_chromosomes(annotation: DataFrame, chromosomes: list[str]) -> list[str]:
    """The list, if all of it occurs in the annotation."""
    known = {r[0] for r in annotation.select("chr").distinct().collect()}
    if missing := sorted(set(chromosomes) - known):
        raise ValueError(f"chromosomes not in the annotation: {missing}")
    return chromosomes

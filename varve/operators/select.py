"""Feature selection: subset, controls, p-value cutoff, largest number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subset(marginals: DataFrame, names: DataFrame) -> DataFrame:
    """The features in ``names`` (feature); an unknown name is an error."""
    unknown = [r[0] for r in names.join(marginals, "feature", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    return marginals.join(names.select("feature").distinct(), "feature", "left_semi")


def select_features(marginals: DataFrame, cutoff: float | None = 0.05, max_num: int | None = None, controls: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """marginals (feature, col_idx, pval, z2) with ``selected``.

    ``only`` comes first, controls are exempt from the other rules, then the
    cutoff (below it, strictly) and the max_num smallest p-values, ties to the
    larger z2 and the first column. Features without a p-value are never
    selected, controls neither; unknown controls don't matter.
    """
    pool = subset(marginals, only) if only is not None else marginals
    names = controls.select("feature").distinct() if controls is not None else None
    kept = pool.join(names, "feature", "left_semi") if names is not None else None
    rest = pool.join(names, "feature", "left_anti") if names is not None else pool
    rest = rest.where("pval is not null and not isnan(pval)")
    if cutoff is not None:
        rest = rest.where(F.col("pval") < cutoff)
    if max_num is not None:
        rest = rest.orderBy("pval", F.desc("z2"), "col_idx").limit(max_num)
    chosen = rest.select("feature")
    if kept is not None:
        chosen = chosen.union(kept.where("pval is not null and not isnan(pval)").select("feature"))
    return marginals.join(chosen.withColumn("selected", F.lit(True)), "feature", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))

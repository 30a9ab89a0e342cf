"""The munge job: a folder of feature files becomes a chunked feature matrix on the annotation's genes."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import munge
from ..sources import files
from ..sources.matrices import export_arrays
from .shipping import ship


def run(spark: SparkSession, gene_annot_path: str, feature_dir: str, save_prefix: str, nan_policy: str = "raise", max_cols: int = 5000, arrays: bool = False) -> None:
    """Writes <prefix>.mat (Parquet, a partition for each chunk), <prefix>.cols and <prefix>.rows.

    arrays: besides, <prefix>.rows.txt, <prefix>.cols.<i>.txt and <prefix>.mat.<i>.npy.
    """
    if nan_policy not in munge.POLICIES:
        raise ValueError(f"nan_policy is one of {', '.join(munge.POLICIES)}")
    spine = files.spine(spark, gene_annot_path)
    if twice := [r["gene"] for r in spine.groupBy("gene").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"genes come twice in the annotation: {twice}")
    frames = files.feature_files(spark, feature_dir)
    features = spark.createDataFrame(list(enumerate(munge.feature_names(frames))), "col_idx long, feature string")
    values = munge.on_spine(spine, frames, max_cols)
    if munge.repeated_genes(munge.pieces(frames, max_cols)).limit(1).count():
        raise ValueError("a feature file lists a gene twice")
    munge.impute(values, nan_policy).write.mode("overwrite").partitionBy("chunk_id").parquet(f"{save_prefix}.mat")
    munge.layout(features, max_cols).write.mode("overwrite").parquet(f"{save_prefix}.cols")
    spine.orderBy("row_idx").select(F.col("row_idx"), F.col("gene")).write.mode("overwrite").parquet(f"{save_prefix}.rows")
    if arrays:
        ship(spark)
        export_arrays(spark, save_prefix, save_prefix)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("gene_annot_path", "feature_dir", "save_prefix"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--nan_policy", default="raise")
    p.add_argument("--max_cols", type=int, default=5000)
    p.add_argument("--arrays", action="store_true", help="write arrays and lists of rows and columns, too")
    run(SparkSession.builder.appName("munge").getOrCreate(), **vars(p.parse_args(argv)))


if __name__ == "__main__":
    main()

"""Reading tables, and tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, if all runs on this machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="varve-")
        atexit.register(folder.cleanup)
        set_to = f"file://{folder.name}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/varve/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the plan starts anew there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote once nothing reads them any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that kept() wrote for this application, once its results are written."""
    _delete(spark, _own_dir(spark))


#: Bytes up to which small_side() broadcasts; larger tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, row_bytes: int | str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table from kept() is within ``limit`` by its measured size.

    row_bytes: bytes of a row, or an expression that gives them.
    """
    return (df.agg(F.sum(F.expr(str(row_bytes)).cast("long"))).first()[0] or 0) <= limit


def small_side(df: DataFrame, row_bytes: int | str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast a table from kept() if it fits; else the table as it is."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df

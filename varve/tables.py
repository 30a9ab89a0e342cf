"""Tables written to the folder that the whole cluster shares, to cut the lineage of iterative jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/varve/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the plan starts anew there, and no executor's loss undoes it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote once nothing reads them any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            deleted(df.sparkSession, name)

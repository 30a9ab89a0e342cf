"""Sends the package to the executors, as --py-files would, so that Python workers can import it."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Bytes that a Python worker gets at once, unless the application sets it; Spark's own bound of rows lets long texts fill a batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's sources. Bounds the batches that Python workers get."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()
    atexit.register(folder.cleanup)  # executors fetch it from here as they start
    target = Path(folder.name) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _sent.add(sc.applicationId)


def shipped(query):
    """The query, run after the package has been sent."""

    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run

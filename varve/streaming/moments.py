"""Marginal association of a stream of genes: moments that add up, batch by batch.

A micro-batch writes two folders under its own id: the rows that it accepts,
each with the row that it takes the place of, and the sums of what they add and
take away. A batch that runs again, after a failure or a restart, overwrites its
own folders with the same contents, since it looks at earlier batches only; so
nothing counts twice. A later revision of a gene takes its former row's moments
away.

Sums are of values less a shift, the first batch's means, where the basis has
an intercept; residual sums don't depend on it, and nearly constant columns keep
their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.association import statistics
from ..operators.orthogonal import lists, matrix

ROWS = "chunk_id int, gene string, version long, x array<double>, y double, v array<double>"
_OLD = ("x", "y", "v")
_SUMS = ("vv", "vz", "zz", "zy")
_MOMENTS = "chunk_id int, n long, " + ", ".join(f"{c} array<double>" for c in _SUMS)
_SHIFTS = "chunk_id int, shift array<double>"


def _moments(v: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
    """Of rows (v, z), z with the target last: v'v, v'z, the columns' squares and their products with the target."""
    return [(v.T @ v).ravel(), (v.T @ z).ravel(), (z * z).sum(0), z.T @ z[:, -1]]


class Moments:
    """The state under ``folder``, which the whole cluster shares.

    Rows come as (chunk_id, gene, version, x, y, v). Of several rows of a gene
    in a chunk the largest version counts, and among equals the last batch's
    (within a batch that of the largest hash). intercept: v[0] is 1 in all rows.
    """

    def __init__(self, spark: SparkSession, folder: str, intercept: bool = True):
        self.spark, self.folder, self.intercept = spark, folder.rstrip("/"), intercept

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """What foreachBatch calls."""
        order = Window.partitionBy("chunk_id", "gene").orderBy(F.desc("version"), F.desc(F.xxhash64("x", "y", "v")))
        newest = rows.select("chunk_id", "gene", F.col("version").cast("long").alias("version"), "x", "y", "v").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
        before = self._table("rows", ROWS).where(F.col("batch") < batch)
        held = F.max_by(F.struct("version", *_OLD), F.struct("version", "batch")).alias("old")
        old = before.join(newest.select("chunk_id", "gene"), ["chunk_id", "gene"], "left_semi").groupBy("chunk_id", "gene").agg(held)
        accepted = newest.join(old, ["chunk_id", "gene"], "left").where("old is null or version >= old.version")
        path = f"{self.folder}/rows/batch={batch}"
        accepted.select("chunk_id", "gene", "version", *_OLD, *[F.col(f"old.{c}").alias(f"old_{c}") for c in _OLD]).write.mode("overwrite").parquet(path)
        taken = self.spark.read.parquet(path)
        self._shift(taken, batch)
        shifts = self._table("shifts", _SHIFTS).where(F.col("batch") <= batch).groupBy("chunk_id").agg(F.min_by("shift", "batch").alias("shift"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for part in batches:
                ids = part.column("chunk_id").to_numpy()
                for chunk in np.unique(ids).tolist():
                    own = part.filter(pa.array(ids == chunk))
                    shift = own.column("shift")[0].values.to_numpy()
                    sums, n = _moments(matrix(own.column("v")), np.column_stack([matrix(own.column("x")), own.column("y").to_numpy()]) - shift), own.num_rows
                    again = own.filter(own.column("old_y").is_valid())
                    if again.num_rows:
                        less = _moments(matrix(again.column("old_v")), np.column_stack([matrix(again.column("old_x")), again.column("old_y").to_numpy()]) - shift)
                        sums, n = [a - b for a, b in zip(sums, less, strict=True)], n - again.num_rows
                    total[chunk] = [n, sums] if chunk not in total else [total[chunk][0] + n, [a + b for a, b in zip(total[chunk][1], sums, strict=True)]]
            for chunk, (n, sums) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n]), *(lists(s.reshape(1, -1)) for s in sums)], names=["chunk_id", "n", *_SUMS])

        taken.join(F.broadcast(shifts), "chunk_id").mapInArrow(run, _MOMENTS).write.mode("overwrite").parquet(f"{self.folder}/moments/batch={batch}")  # a shift for each chunk

    def _shift(self, rows: DataFrame, batch: int) -> None:
        """Chunks that no earlier batch had get the means of this one's values, or zeros without an intercept."""
        known = self._table("shifts", _SHIFTS).where(F.col("batch") < batch).select("chunk_id").distinct()
        z = F.concat("x", F.array("y"))
        means = rows.join(known, "chunk_id", "left_anti").select("chunk_id", F.posexplode(z).alias("pos", "value")).groupBy("chunk_id", "pos").agg(F.avg("value").alias("mean"))
        shift = means.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("all")).select("chunk_id", F.transform("all", lambda s: s["mean"] if self.intercept else F.lit(0.0)).alias("shift"))
        shift.write.mode("overwrite").parquet(f"{self.folder}/shifts/batch={batch}")

    def residuals(self) -> DataFrame:
        """(chunk_id, pos, ssx, sxy, ssy, variance, n) of all batches so far: sums of squares and products of residuals."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total = None, None

            def out() -> pa.RecordBatch:
                n, vv, vz, zz, zy = total
                k, width = int(round(len(vv) ** 0.5)), len(zz)
                coef = np.linalg.solve(vv.reshape(k, k), vz.reshape(k, width))
                left, products = zz - (vz.reshape(k, width) * coef).sum(0), zy - coef.T @ vz.reshape(k, width)[:, -1]
                mean = (vz.reshape(k, width)[0, -1] - vv.reshape(k, k)[0] @ coef[:, -1]) / n  # of residuals, as v[0] is 1
                p, whole = width - 1, lambda v: pa.array(np.full(width - 1, v))
                return pa.RecordBatch.from_arrays([pa.array(np.full(p, last, np.int32)), pa.array(np.arange(p, dtype=np.int32)), pa.array(left[:-1]), pa.array(products[:-1]), whole(left[-1]), whole(left[-1] / n - mean**2), whole(n)], names=["chunk_id", "pos", "ssx", "sxy", "ssy", "variance", "n"])

            for batch in batches:
                for i in range(batch.num_rows):
                    row = [batch.column("n")[i].as_py(), *(batch.column(c)[i].values.to_numpy() for c in _SUMS)]
                    if (chunk := batch.column("chunk_id")[i].as_py()) != last:
                        if last is not None:
                            yield out()
                        last, total = chunk, row
                    else:
                        total = [a + b for a, b in zip(total, row, strict=True)]
            if last is not None:
                yield out()

        sums = self._table("moments", _MOMENTS).drop("batch")
        return sums.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(run, "chunk_id int, pos int, ssx double, sxy double, ssy double, variance double, n long")

    def marginal(self) -> DataFrame:
        """(chunk_id, pos, beta, se, z2, pval, r2, n) of the genes so far, as association.marginal() gives them of a table. The basis has an intercept."""
        now = self.residuals()
        first = now.select("ssy", "variance", "n").first()
        if first is None:
            raise ValueError("no batch has come yet")
        return statistics(now.select("chunk_id", "pos", "ssx", "sxy"), *first).select("chunk_id", "pos", "beta", "se", "z2", "pval", "r2", "n")

    def follow(self, stream: DataFrame) -> None:
        """Takes in what a stream of rows has, and returns when it is through; called again, it goes on from there."""
        stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

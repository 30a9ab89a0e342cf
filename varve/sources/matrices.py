"""Feature matrices, and error covariances from matrix files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.covariance import BROADCAST_BYTES, by_label
from . import files
from .arrays import PARTITION_BYTES, array_rows, header, write_array_rows

LAYOUT = "chunk_id int, pos int, col_idx long, feature string"


def _as_arrays(spark: SparkSession, prefix: str) -> bool:
    """Whether a matrix lies as arrays with lists of rows and columns, not as the munge job's tables."""
    return not files.exists(spark, f"{prefix}.rows") and files.exists(spark, f"{prefix}.rows.txt")


def _listed_rows(spark: SparkSession, prefix: str) -> DataFrame:
    genes = files.lines(spark, f"{prefix}.rows.txt").select("row_idx", F.trim("line").alias("gene"))
    return genes.select((F.row_number().over(Window.orderBy("row_idx")) - 1).cast("long").alias("row_idx"), "gene")  # a row for each gene


def read_rows(spark: SparkSession, prefix: str) -> DataFrame:
    """(row_idx, gene): the matrix's rows in order. A gene that comes twice is an error."""
    rows = _listed_rows(spark, prefix) if _as_arrays(spark, prefix) else spark.read.parquet(f"{prefix}.rows").select("row_idx", "gene")
    if twice := [r["gene"] for r in rows.groupBy("gene").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"genes come twice in the matrix: {twice}")
    return rows


def _array_layout(spark: SparkSession, prefix: str, chunks: int, n: int) -> DataFrame:
    """The columns of arrays, their shapes held against the lists of rows and columns; only heads are read."""
    first, layouts = 0, []
    for i in range(chunks):
        shape, *_ = header(f"{prefix}.mat.{i}.npy")
        names = [r["line"] for r in files.lines(spark, f"{prefix}.cols.{i}.txt").orderBy("row_idx").select(F.trim("line").alias("line")).collect()]
        if shape != (n, len(names)):
            raise ValueError(f"{prefix}.mat.{i}.npy is {shape}, there are {n} rows and {len(names)} features")
        layouts += [(i, k, first + k, name) for k, name in enumerate(names)]
        first += len(names)
    return spark.createDataFrame(layouts, LAYOUT)


def import_arrays(spark: SparkSession, prefix: str, chunks: int, to: str, rows_at_once: int | None = None) -> None:
    """Reads a matrix kept as <prefix>.rows.txt, <prefix>.cols.<i>.txt and <prefix>.mat.<i>.npy and writes it to ``to`` as the munge job does."""
    mat, cols = read_matrix(spark, prefix, chunks, rows_at_once)
    _listed_rows(spark, prefix).write.mode("overwrite").parquet(f"{to}.rows")
    mat.join(spark.read.parquet(f"{to}.rows"), "gene").select("chunk_id", "row_idx", "gene", "x").write.mode("overwrite").partitionBy("chunk_id").parquet(f"{to}.mat")
    cols.write.mode("overwrite").parquet(f"{to}.cols")


def export_arrays(spark: SparkSession, prefix: str, to: str) -> None:
    """Writes a matrix as <to>.rows.txt, <to>.cols.<i>.txt and <to>.mat.<i>.npy; missing values are NaN."""
    rows, (mat, cols) = read_rows(spark, prefix), read_matrix(spark, prefix)
    placed = mat.join(F.broadcast(rows) if rows.count() * 64 <= BROADCAST_BYTES else rows, "gene")
    array_values = F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))
    write_array_rows(placed.select("chunk_id", "row_idx", array_values.alias("x")), f"{to}.mat")
    files.write_lines(rows, "row_idx", "gene", f"{to}.rows.txt")
    for i in sorted(r["chunk_id"] for r in cols.select("chunk_id").distinct().collect()):
        files.write_lines(cols.where(F.col("chunk_id") == i), "pos", "feature", f"{to}.cols.{i}.txt")


def read_matrix(spark: SparkSession, prefix: str, chunks: int | None = None, rows_at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, gene, x) and the layout (chunk_id, pos, col_idx, feature); ``chunks``: the first so many.

    The matrix is what the munge job wrote, or else arrays with their lists,
    <prefix>.rows.txt, <prefix>.cols.<i>.txt and <prefix>.mat.<i>.npy, which
    are read in ranges of rows, whatever their size.
    """
    if _as_arrays(spark, prefix):
        if not chunks:
            raise ValueError("say how many arrays the matrix has")
        rows = read_rows(spark, prefix)
        n = rows.count()
        cols = _array_layout(spark, prefix, chunks, n)
        values = array_rows(spark, f"{prefix}.mat", chunks, rows_at_once=rows_at_once)
        return values.join(F.broadcast(rows) if n * 64 <= BROADCAST_BYTES else rows, "row_idx").select("chunk_id", "gene", "x"), cols
    mat, cols = spark.read.parquet(f"{prefix}.mat"), spark.read.parquet(f"{prefix}.cols")
    if chunks:
        mat, cols = mat.where(F.col("chunk_id") < chunks), cols.where(F.col("chunk_id") < chunks)
    return mat.select("chunk_id", "gene", "x"), cols


def sparse_rows(data: bytes) -> tuple[tuple[int, int], Iterator[np.ndarray]]:
    """The shape and, row by row, the numbers of an .npz with a compressed sparse matrix."""
    z = np.load(io.BytesIO(data))
    kind, shape = z["format"].item(), tuple(int(v) for v in z["shape"])
    kind = kind.decode() if isinstance(kind, bytes) else str(kind)
    if kind == "coo":
        row, col = z["row"], z["col"]
    else:
        major = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
        row, col = (major, z["indices"]) if kind == "csr" else (z["indices"], major)
    order = np.argsort(row, kind="stable")
    at, col, value = np.searchsorted(row[order], np.arange(shape[0] + 1)), col[order], z["data"][order]
    return shape, (np.bincount(col[a:b], value[a:b], shape[1]) for a, b in zip(at, at[1:], strict=False))


def read_covariance(spark: SparkSession, path: str, target: DataFrame, labels: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(chr, i, y_idx, gene, r, d): blocks by label (gene, chr) of a matrix over the target's genes, in the target's order.

    An .npy is read in ranges of rows by many tasks; an .npz, which is
    compressed and sparse, by one, row by row.
    """
    n = target.count()

    def wrong(shape: tuple[int, ...]) -> ValueError:
        return ValueError(f"the error covariance is {shape}, the target has {n} genes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                shape, found = sparse_rows(data.as_py())
                if shape != (n, n):
                    raise wrong(shape)
                for i, x in enumerate(found):
                    yield pa.RecordBatch.from_pydict({"y_idx": [i], "x": [x]})

    if path.endswith(".npz"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "y_idx long, x array<double>")
    else:
        if (shape := header(path)[0]) != (n, n):
            raise wrong(shape)
        rows = array_rows(spark, path, partition_bytes=partition_bytes, symmetric=True).select(F.col("row_idx").alias("y_idx"), "x")
    lower = rows.select("y_idx", F.slice("x", F.lit(1), F.col("y_idx").cast("int")).alias("r"), F.get("x", F.col("y_idx").cast("int")).alias("d"))
    return by_label(lower.join(target.select("y_idx", "gene"), "y_idx"), labels)


def ranked(rows: DataFrame) -> DataFrame:
    """(gene, order) with the order's place from 0; a row for each training gene."""
    return rows.select("gene", (F.row_number().over(Window.orderBy("order")) - 1).alias("order"))

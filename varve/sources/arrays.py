"""Arrays in NumPy's file format as a data source: ranges of rows are the partitions, so an array of any size is read and written by many tasks."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of an array that a partition reads, and that one batch holds.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    where, at = located(path)
    return where.open_input_file(at)


def created(path: str) -> pa.NativeFile:
    where, at = located(path)
    return where.open_output_stream(at)


def moved(path: str, to: str) -> None:
    where, at = located(path)
    where.move(at, located(to)[1])


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int, bool]:
    """Shape, kind, place of the first number, and whether the columns come first; only the head is read."""
    with opened(path) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        return shape, kind, f.tell(), by_columns


@dataclass
class Rows(InputPartition):
    chunk: int
    path: str
    kind: str
    place: int  # of the first number
    width: int
    first: int
    stop: int


class ArraySource(DataSource):
    """``numpy_rows``: (chunk_id, row_idx, x) of matrices <path>.<i>.npy for i below ``chunks``, or of the one matrix ``path``.

    Options: path, chunks, partition_bytes, rows_at_once (of a batch) and
    symmetric. Matrices are of numbers, in row order unless they are symmetric;
    NaN stays NaN.
    """

    @classmethod
    def name(cls) -> str:
        return "numpy_rows"

    def schema(self) -> str:
        return "chunk_id int, row_idx long, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(self.options)


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunks = options["path"], options.get("chunks")
        self.symmetric = options.get("symmetric") == "true"  # rows and columns are the same
        self.bytes, self.step = int(options.get("partition_bytes", PARTITION_BYTES)), int(options.get("rows_at_once", 0))

    def partitions(self) -> list[Rows]:
        paths = [self.path] if self.chunks is None else [f"{self.path}.{i}.npy" for i in range(int(self.chunks))]
        out = []
        for i, path in enumerate(paths):
            shape, kind, place, by_columns = header(path)
            if by_columns and not self.symmetric or len(shape) != 2 or kind.kind not in "fiu":
                raise ValueError(f"{path} is {shape} of {kind}{', columns first' if by_columns else ''}")
            step = max(1, self.bytes // max(1, shape[1] * kind.itemsize))
            out += [Rows(i, path, kind.str, place, shape[1], a, min(a + step, shape[0])) for a in range(0, shape[0], step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p, kind = partition, np.dtype(partition.kind)
        step = self.step or max(1, BATCH_BYTES // max(1, 8 * p.width))
        with opened(p.path) as f:
            f.seek(p.place + p.first * p.width * kind.itemsize)
            for a in range(p.first, p.stop, step):
                many = min(step, p.stop - a)
                data = f.read(many * p.width * kind.itemsize)
                x = np.frombuffer(data, kind).astype(np.float64)
                if len(x) < many * p.width:
                    raise ValueError(f"{p.path} ends early")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, p.width, dtype=np.int32) if p.width else np.zeros(many + 1, np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, p.chunk, np.int32)), pa.array(np.arange(a, a + many)), lists], names=["chunk_id", "row_idx", "x"])


@dataclass
class Parts(WriterCommitMessage):
    files: list[tuple[int, int, int, int, str]]  # chunk, first row, rows, columns, path


class ArrayWriter(DataSourceArrowWriter):
    """Writes <path>.<i>.npy for each chunk_id i. A task writes the runs of rows that it has to parts of its own; the commit
    puts a head before them and joins them in order, so a matrix is there whole or not at all, and repeated tasks leave nothing."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        files, out, own = [], None, None
        for batch in iterator:
            chunks, rows = batch.column("chunk_id").to_numpy(), batch.column("row_idx").to_numpy()
            for k in range(batch.num_rows):
                x = np.asarray(batch.column("x")[k].values.to_numpy(zero_copy_only=False), "<f8")
                if own is None or (chunks[k], rows[k]) != (own[0], own[1] + own[2]):
                    if out is not None:
                        out.close()
                        files.append(tuple(own))
                    own = [int(chunks[k]), int(rows[k]), 0, len(x), f"{self.path}.{chunks[k]}.part-{uuid.uuid4().hex}"]
                    out = created(own[4])
                if len(x) != own[3]:
                    raise ValueError(f"rows of chunk {own[0]} have {own[3]} and {len(x)} columns")
                out.write(x.tobytes())
                own[2] += 1
        if out is not None:
            out.close()
            files.append(tuple(own))
        return Parts(files)

    def commit(self, messages: list[Parts | None]) -> None:
        parts = sorted(f for m in messages if m is not None for f in m.files)
        try:
            for chunk in sorted({f[0] for f in parts}):
                own = [f for f in parts if f[0] == chunk]
                at = 0
                for _, first, many, width, _ in own:
                    if first != at or width != own[0][3]:
                        raise ValueError(f"chunk {chunk} has no row {at}, or one twice" if first != at else f"rows of chunk {chunk} have {own[0][3]} and {width} columns")
                    at += many
                whole = f"{self.path}.{chunk}.npy"
                with created(f"{whole}.unfinished") as out:
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (at, own[0][3])})
                    out.write(head.getvalue())
                    for *_, path in own:
                        with opened(path) as part:
                            while data := part.read(BATCH_BYTES):
                                out.write(data)
                moved(f"{whole}.unfinished", whole)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        for m in messages:
            for *_, path in m.files if m is not None else []:
                where, at = located(path)
                where.delete_file(at)


def array_rows(spark: SparkSession, path: str, chunks: int | None = None, partition_bytes: int = PARTITION_BYTES, rows_at_once: int | None = None, symmetric: bool = False) -> DataFrame:
    spark.dataSource.register(ArraySource)
    given = {"path": path, "chunks": chunks, "partition_bytes": partition_bytes, "rows_at_once": rows_at_once, "symmetric": str(symmetric).lower()}
    return spark.read.format("numpy_rows").options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def write_array_rows(rows: DataFrame, path: str) -> None:
    """Writes (chunk_id, row_idx, x) as matrices <path>.<i>.npy; row_idx has to count from 0 in every chunk."""
    rows.sparkSession.dataSource.register(ArraySource)
    ordered = rows.select(F.col("chunk_id").cast("int"), F.col("row_idx").cast("long"), "x").repartitionByRange("chunk_id", "row_idx").sortWithinPartitions("chunk_id", "row_idx")
    ordered.write.format("numpy_rows").option("path", path).mode("append").save()

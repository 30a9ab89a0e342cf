"""Cholesky of one large block in square tiles that many tasks share.

Left-looking: the tiles of a column of the factor are those of the matrix less
the products of the factor's columns before, then solved by the column's own
corner. Each finished column is written once, in a folder for itself; a column
takes two jobs, whose plans don't grow: one multiplies and adds up, one solves.
A task holds a few tiles, or, where rows are given out, one strip of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import deleted, dropped, kept, new_path

#: Rows and columns of a tile: 2 MB.
SIDE = 512
_TILE = "ti int, tj int, data binary"


def _out(ti: list[int], tj: list[int], data: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ti, pa.int32()), pa.array(tj, pa.int32()), pa.array([np.ascontiguousarray(d).tobytes() for d in data], pa.binary())], names=["ti", "tj", "data"])


def _rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Row by row: a column as a list of all rows would copy every tile of the batch."""
    for batch in batches:
        own = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() if not pa.types.is_list(c.type) else c[k].values.to_numpy(zero_copy_only=False) for c in own)


def _tile(data: bytes, side: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, side)


def _assembled(block: DataFrame, n: int, added: float, side: int) -> DataFrame:
    """(ti, tj, data): the lower tiles of a block (i, r, d), ``added`` on its diagonal; rows and columns beyond n are 0, but 1 on the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tile = None, None

        def done() -> pa.RecordBatch:
            if last[0] == last[1]:
                tile[np.diag_indices(side)] += np.where(np.arange(side) + last[0] * side < n, 0.0, 1.0)
            return _out([last[0]], [last[1]], [tile])

        for ti, tj, row, at, piece in _rows_of(batches, "ti", "tj", "row", "at", "piece"):
            if (ti, tj) != last:
                if last is not None:
                    yield done()
                last, tile = (ti, tj), np.zeros((side, side))
            tile[row, at : at + len(piece)] = piece
        if last is not None:
            yield done()

    # row i from its first column on, the diagonal last; each tile of its strip gets a piece, if an empty one, so no tile is lacking
    whole, start = F.concat("r", F.array(F.col("d") + F.lit(added))), F.col("i") - F.size("r")
    at = lambda t: F.least(F.greatest(start - t * side, F.lit(0)), F.lit(side)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.col("i") / side).cast("int")), lambda t: F.struct(t.alias("tj"), at(t).alias("at"), F.slice(whole, F.greatest(t * side + at(t) - start + 1, F.lit(1)).cast("int"), F.lit(side) - at(t)).alias("piece")))
    cut = block.select(F.floor(F.col("i") / side).cast("int").alias("ti"), (F.col("i") % side).cast("int").alias("row"), "i", "r", "d").select("ti", "row", F.inline(pieces))
    return cut.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, _TILE)


def tiled(block: DataFrame, n: int, added: float = 0.0, side: int | None = None) -> DataFrame:
    """(chr, gene, i, dl, l): the rows of the factor of one block (chr, gene, i, r, d) of n rows, as factors() makes them of small blocks."""
    side = side or SIDE
    spark, strips = block.sparkSession, -(-n // side)
    given = kept(_assembled(block, n, added, side), "tiles")
    home = new_path(spark, "factor")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """L_ij L_kj' for the tiles of each column j, that of strip k first; what a task makes for a strip is added up."""
        column, lead, sums = None, None, {}
        for ti, tj, data in _rows_of(batches, "ti", "tj", "data"):
            tile = _tile(data, side)
            if tj != column:
                column, lead = tj, tile
            if ti in sums:
                sums[ti] += tile @ lead.T
            else:
                sums[ti] = tile @ lead.T
            if len(sums) > 8:
                yield _out([*sums], [-1] * len(sums), [*sums.values()])
                sums = {}
        if sums:
            yield _out([*sums], [-1] * len(sums), [*sums.values()])

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, total = None, None
        for ti, tj, data in _rows_of(batches, "ti", "tj", "data"):
            if ti != strip:
                if strip is not None:
                    yield _out([strip], [0], [total])
                strip, total = ti, np.zeros((side, side))
            total += _tile(data, side) if tj >= 0 else -_tile(data, side)
        if strip is not None:
            yield _out([strip], [0], [total])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = None
        for ti, data, corner in _rows_of(batches, "ti", "data", "corner"):
            if inverse is None:
                own = _tile(corner, side)
                low = np.linalg.cholesky(np.tril(own) + np.tril(own, -1).T)
                inverse = np.linalg.solve(low, np.eye(side))
            yield _out([ti], [0], [low if data == corner else _tile(data, side) @ inverse.T])

    for k in range(strips):
        own = given.where(F.col("tj") == k)
        if k:
            before = spark.read.schema(_TILE).parquet(home).where((F.col("tj") < k) & (F.col("ti") >= k))
            parts = before.repartition("tj").sortWithinPartitions("tj", "ti").mapInArrow(products, _TILE)
            own = kept(own.unionByName(parts).repartition("ti").sortWithinPartitions("ti").mapInArrow(added_up, _TILE), "column")
        corner = F.broadcast(own.where(F.col("ti") == k).select(F.col("data").alias("corner")))  # one tile
        own.join(corner).select("ti", "data", "corner").mapInArrow(solved, _TILE).drop("tj").write.parquet(f"{home}/tj={k}")
        if k:
            dropped(own)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, parts = None, []

        def given_out() -> Iterator[pa.RecordBatch]:
            whole = np.hstack(parts)
            many = min(side, n - strip * side)
            for a in range(0, many, 64):
                at = np.arange(a, min(a + 64, many))
                own = [whole[k, : strip * side + k] for k in at]
                offsets = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(strip * side + at), pa.array(whole[at, strip * side + at]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))], names=["i", "dl", "l"])

        for ti, data in _rows_of(batches, "ti", "data"):
            if ti != strip:
                if strip is not None:
                    yield from given_out()
                strip, parts = ti, []
            parts.append(_tile(data, side))
        if strip is not None:
            yield from given_out()

    dropped(given)
    factor = spark.read.schema(_TILE).parquet(home)
    long = kept(factor.repartition("ti").sortWithinPartitions("ti", "tj").mapInArrow(rows, "i long, dl double, l array<double>"), "factor_rows")
    deleted(spark, home)
    reach = block.select("chr", "gene", "i", F.size("r").alias("reach"))
    return long.join(reach, "i").select("chr", "gene", "i", "dl", F.slice("l", (F.col("i") - F.col("reach") + 1).cast("int"), F.col("reach")).alias("l"))

"""Tall matrices whose rows are arrays: triangular factors by a tree, kernels and products with a few vectors.

No step forms X'X of more columns than the caller asks for, and none moves the
rows but to cut their columns into chunks. Products go on as sums of a task,
added up tile by tile after a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that merge the factors of all others before the last one does.
FAN = 16
#: Rows and columns of a tile of a kernel; bytes of a chunk of columns, and of the sums that a task holds before it sends them.
SIDE, CHUNK_BYTES, HELD = 512, 32 << 20, 128 << 20
#: Numbers of a sum that are sent in one row.
TILE = 512


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def triangle(x: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of x: as many rows as there are columns at most."""
    return np.linalg.qr(x, mode="r")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(matrix(batch.column("z")))
            many += len(held[-1])
            if many >= 4 * held[0].shape[1] + 256:
                held = [triangle(np.vstack(held))]
                many = len(held[0])
    if held:
        yield pa.RecordBatch.from_arrays([lists(triangle(np.vstack(held)))], names=["z"])


def r_factor(rows: DataFrame) -> np.ndarray:
    """R with R'R = Z'Z for rows (z) of one length, null for none; Z itself is as well conditioned as R, unlike Z'Z.

    A task makes the R of its rows, FAN tasks those of all Rs, one that of
    theirs. Z of rank r has an R whose rows may be fewer than its columns.
    """
    kind = "z array<double>"
    parts = rows.select("z").mapInArrow(_folded, kind)
    for n in (FAN, 1):
        parts = parts.repartition(n).mapInArrow(_folded, kind)
    z = parts.toArrow().column("z")
    if not len(z):
        raise ValueError("there are no rows")
    return matrix(z)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows of one place (i, j), which stand together."""
    last, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), lists(total[None])], names=["i", "j", "s"])
    for batch in batches:
        values = matrix(batch.column("s"))
        for k, at in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)):
            if at != last:
                if last is not None:
                    yield out()
                last, total = at, values[k].copy()
            else:
                total += values[k]
    if last is not None:
        yield out()


_SUMS = "i long, j long, s array<double>"


def _summed(parts: DataFrame) -> pa.Table:
    return parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_added, _SUMS).toArrow()


def weighed_sums(rows: DataFrame, weights, p: int, m: int) -> np.ndarray:
    """X'W for rows with x, of p columns: weights(batch, x) gives a batch's m columns of W. One pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, m))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                total += x.T @ weights(batch, x)
        wide = np.zeros((-(-total.size // TILE), TILE))
        wide.ravel()[: total.size] = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wide))), pa.array(np.zeros(len(wide), np.int64)), lists(wide)], names=["i", "j", "s"])

    found = _summed(rows.mapInArrow(run, _SUMS))
    flat = np.zeros((-(-p * m // TILE), TILE))
    for batch in found.to_batches():
        flat[batch.column("i").to_numpy()] = matrix(batch.column("s"))
    return flat.ravel()[: p * m].reshape(p, m)


def column_sums(rows: DataFrame, ids: np.ndarray, weights: np.ndarray, p: int) -> np.ndarray:
    """X'W for rows (id, x) of p columns; weights has a line for each of ids, which are sorted. Rows of other ids count nothing."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, weights))  # a few numbers a row

    def own(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        known, w = sent.value
        given = batch.column("id").to_numpy()
        at = np.minimum(np.searchsorted(known, given), len(known) - 1)
        return np.where((known[at] == given)[:, None], w[at], 0.0)

    out = weighed_sums(rows.select("id", "x"), own, p, weights.shape[1])
    sent.destroy()
    return out


def kernel(rows: DataFrame, n: int) -> np.ndarray:
    """XX' of rows (id, x), n of them, in the order of their ids, added up over chunks of columns.

    A task takes all rows of one chunk; the n x n sums go on in tiles.
    """
    width = max(16, CHUNK_BYTES // (8 * max(1, n)))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("x") - 1) / width).cast("int"))), lambda k: F.struct(k.alias("chunk"), F.slice("x", k * width + 1, F.lit(width)).alias("part")))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            at = np.array(list(sums), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), lists(np.stack([s.ravel() for s in sums.values()]))], names=["i", "j", "s"])

        def multiplied(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(x) != n:
                raise ValueError(f"{len(x)} rows, not {n}")
            for i in range(0, n, SIDE):
                for j in range(0, i + 1, SIDE):
                    tile = np.zeros((SIDE, SIDE))
                    part = x[i : i + SIDE] @ x[j : j + SIDE].T
                    tile[: part.shape[0], : part.shape[1]] = part
                    sums[i, j] = sums[i, j] + tile if (i, j) in sums else tile
                    if len(sums) * SIDE * SIDE * 8 >= HELD:
                        yield sent()
                        sums.clear()

        last, held = None, []
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            x = matrix(batch.column("part")) if len(np.unique(chunk)) == 1 else None
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist()], [*edges[1:], len(chunk)], strict=True):
                if a == b:
                    continue
                if last is not None and chunk[a] != last:
                    yield from multiplied(np.vstack(held))
                    held = []
                last = chunk[a]
                held.append(x if x is not None else matrix(batch.column("part").slice(a, b - a)))
        if held:
            yield from multiplied(np.vstack(held))
        if sums:
            yield sent()

    parts = rows.select("id", F.inline(cut)).repartition("chunk").sortWithinPartitions("chunk", "id").mapInArrow(products, _SUMS)
    found, out = _summed(parts), np.zeros((n, n))
    for batch in found.to_batches():
        for i, j, tile in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), matrix(batch.column("s")), strict=True):
            a, b = min(SIDE, n - i), min(SIDE, n - j)
            out[i : i + a, j : j + b] = tile.reshape(SIDE, SIDE)[:a, :b]
            out[j : j + b, i : i + a] = out[i : i + a, j : j + b].T
    return out

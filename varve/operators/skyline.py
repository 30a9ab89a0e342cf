"""Cholesky factors of block covariances kept as ragged rows, and whitening by forward substitution.

A row of a block has its correlations with the places just before it, as far
back as any is given; the factor's rows reach back just as far, so factors are
ragged rows, too, and no square block or inverse is made. A block streams
through a task in the order of its places, a strip of TILE rows at a time,
which is a few products of small matrices; what is held is the strips that
later rows can still reach. Blocks whose factor is beyond LARGE go to tiles
that many tasks share, see tiles.py. Where it is the inverse of the factor
that is ragged, as with an autoregression, its rows are given in the factor's
place, and whitening multiplies by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept

#: Rows of a strip; bytes of a factor, or of its strips held at once, up to which one task makes it; bytes of whitened values that a task holds.
TILE, LARGE, HELD = 64, 256 << 20, 64 << 20


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of arrays, and where each row's begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _ragged(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0)])))


def _batch(columns: dict[str, list], arrays: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(v) for v in columns.values()), *(_ragged(v) for v in arrays.values())], names=[*columns, *arrays])


def recut(blocks: DataFrame) -> DataFrame:
    """(chr, own, y_idx, gene, i, r, d): rows of blocks with ``own`` alone, as blocks by chr and own; i is the place within.

    Rows without ``own`` go. A block streams by; what is held is a number for
    each of its rows.
    """
    schema = "chr string, own string, y_idx long, gene string, d double, i long, r array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes, count, labels = None, {}, {}, []
        for batch in batches:
            values, at = _lists(batch.column("r"))
            out, tails = {c: [] for c in ("chr", "own", "y_idx", "gene", "d", "i")}, []
            for k, (chr_, own, y_idx, gene, d) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chr", "own", "y_idx", "gene", "d")), strict=True)):
                if chr_ != last:
                    last, codes, count, labels = chr_, {}, {}, []
                code = codes.setdefault(own, len(codes))
                if own is not None:
                    r = values[at[k] : at[k + 1]]
                    before = np.array(labels[len(labels) - len(r) :], np.int64)
                    tails.append(r[before == code])
                    for c, v in zip(out, (chr_, own, y_idx, gene, d, count.get(own, 0)), strict=True):
                        out[c].append(v)
                    count[own] = count.get(own, 0) + 1
                labels.append(code)
            if tails:
                yield _batch(out, {"r": tails})

    return blocks.select("chr", "own", "y_idx", "gene", "i", "r", "d").repartition("chr").sortWithinPartitions("chr", "i").mapInArrow(run, schema)


def _shapes(blocks: DataFrame) -> DataFrame:
    """(chr, n, band, cells) of each block: rows, the longest way back, numbers of its factor."""
    return blocks.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("r")).cast("long").alias("band"), F.sum(F.size("r") + 1).alias("cells"))


class Strips:
    """The factor's strips so far of one block; ``push`` makes the next ones."""

    def __init__(self, band: int):
        self.band, self.done, self.strips = band, 0, []  # (first column, rows, inverse of the corner)

    def push(self, tails: list[np.ndarray], diagonal: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The factor's rows of the next TILE rows (fewer at the end): what is before the diagonal, and the diagonal."""
        t, row = len(tails), self.done
        low = min(row + k - len(tail) for k, tail in enumerate(tails))
        first = min(max(low, 0) // TILE * TILE, row)
        own = np.zeros((t, row + t - first))
        for k, tail in enumerate(tails):
            own[k, row + k - len(tail) - first : row + k - first] = tail
            own[k, row + k - first] = diagonal[k]
        for start, rows, inverse in self.strips:
            end = start + rows.shape[1]
            begin = end - len(inverse)
            if begin < first:
                continue
            shared = max(start, first)
            left = own[:, begin - first : end - first] - own[:, shared - first : begin - first] @ rows[:, shared - start : begin - start].T
            own[:, begin - first : end - first] = left @ inverse.T
        corner = own[:, row - first :]
        corner = np.tril(corner) + np.tril(corner, -1).T - own[:, : row - first] @ own[:, : row - first].T
        corner = np.linalg.cholesky(corner)
        own[:, row - first :] = corner
        self.strips.append((first, own, np.linalg.solve(corner, np.eye(t))))
        self.done += t
        self.strips = [s for s in self.strips if s[0] + s[1].shape[1] > self.done - self.band]
        return [own[k, row + k - len(tail) - first : row + k - first] for k, tail in enumerate(tails)], np.diag(corner)


FACTOR = "chr string, gene string, i long, n long, band long, dl double, l array<double>"


def _streamed(blocks: DataFrame, shapes: DataFrame, added: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ("chr", "gene", "i", "n", "band", "d", "r")}
        strips = None

        def made() -> pa.RecordBatch:
            nonlocal strips
            if held["i"][0] == 0:
                strips = Strips(held["band"][0])
            l, dl = strips.push(held.pop("r"), np.array(held.pop("d")) + added)
            out = _batch({**held, "dl": dl.tolist()}, {"l": l})
            for c in ("chr", "gene", "i", "n", "band", "d", "r"):
                held[c] = []
            return out

        for batch in batches:
            values, at = _lists(batch.column("r"))
            for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chr", "gene", "i", "n", "band", "d")), strict=True)):
                for c, v in zip(("chr", "gene", "i", "n", "band", "d"), own, strict=True):
                    held[c].append(v)
                held["r"].append(values[at[k] : at[k + 1]])
                if len(held["i"]) == TILE or own[2] == own[3] - 1:
                    yield made()

    rows = blocks.select("chr", "gene", "i", "r", "d").join(F.broadcast(shapes), "chr")  # a row for each block
    return rows.repartition("chr").sortWithinPartitions("chr", "i").mapInArrow(run, FACTOR)


def factors(blocks: DataFrame, added: float = 0.0) -> DataFrame:
    """(chr, gene, i, n, band, dl, l) for blocks (chr, gene, i, r, d): rows of each block's Cholesky factor with ``added`` on its diagonal.

    l are the numbers before the diagonal dl; n and band are the block's rows
    and longest way back. A block that isn't positive definite is an error.
    Only genes of a mask may be in ``blocks``, since the factor of a part is not
    the part of a factor; see recut(). The rows are written down, as every
    whitening reads them.
    """
    from .tiles import tiled

    shapes = [(r["chr"], r["n"], r["band"], r["cells"]) for r in _shapes(blocks).collect()]  # a row for each block
    kinds = "chr string, n long, band long, cells long"
    spark = blocks.sparkSession
    # a narrow band's strips are few, however long the block
    large = [s[0] for s in shapes if min(s[3], s[2] * (s[2] + TILE)) * 8 > LARGE]
    table = spark.createDataFrame(shapes, kinds).drop("cells")
    out = _streamed(blocks.where(~F.col("chr").isin(large)) if large else blocks, table, added)
    for chr_, n, band, _ in (s for s in shapes if s[0] in large):
        out = out.union(tiled(blocks.where(F.col("chr") == chr_), n, added).select("chr", "gene", "i", F.lit(n).cast("long").alias("n"), F.lit(band).cast("long").alias("band"), "dl", "l"))
    return kept(out, "factors")


def whiten(values: DataFrame, rows: DataFrame, name: str = "x", inverse: bool = False) -> DataFrame:
    """(chr, chunk_id, i, gene, x): values (chunk_id, gene, x) of the genes of factors ``rows``, each block solved by its factor.

    ``inverse``: the rows are those of the factors' inverses, by which values
    are multiplied. A task takes one block of one chunk, or a slice of its columns where the
    factor reaches far back, and holds only what later rows reach. A gene with
    no values in a chunk, or with two rows of them, is an error.
    """
    band = rows.agg(F.max("band")).first()[0] or 0
    width = max(64, HELD // (8 * (band + TILE)))
    joined = values.select("chunk_id", "gene", F.col(name).alias("x")).join(rows, "gene")
    few = values.select(F.size(name)).first()
    sliced = few is not None and few[0] > width
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("x") - 1) / width).cast("int"))), lambda k: F.struct(k.alias("cut"), F.slice("x", k * width + 1, F.lit(width)).alias("x")))
    joined = joined.select("chunk_id", "gene", *rows.drop("gene").columns, F.inline(cut)) if sliced else joined.withColumn("cut", F.lit(0))
    key = ["chr", "chunk_id", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window, done, held = None, None, 0, []

        def made() -> pa.RecordBatch:
            nonlocal window, done, held
            t, first = len(held), done - len(window)
            low = np.zeros((t, len(window) + t))
            for k, (_, l, dl, _, _) in enumerate(held):
                low[k, done + k - len(l) - first : done + k - first] = l
                low[k, len(window) + k] = dl
            x = np.stack([h[3] for h in held])
            before, corner = low[:, : len(window)] @ window, low[:, len(window) :]
            z = before + corner @ x if inverse else np.linalg.solve(corner, x - before)
            out = _batch({"chr": [last[0]] * t, "chunk_id": pa.array([last[1]] * t, pa.int32()), "cut": pa.array([last[2]] * t, pa.int32()), "i": list(range(done, done + t)), "gene": [h[0] for h in held]}, {"x": list(z)})
            window = np.vstack([window, x if inverse else z])[-held[0][4] :] if held[0][4] else window[:0]
            done, held = done + t, []
            return out

        def ended(n: int) -> None:
            if done < n:
                raise ValueError(f"genes without values: {n - done} of chromosome {last[0]}, chunk {last[1]}")

        size = 0
        for batch in batches:
            lists = {c: _lists(batch.column(c)) for c in ("x", "l")}
            for k, (*own, i, n, band, gene, dl) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*key, "i", "n", "band", "gene", "dl")), strict=True)):
                x, l = (v[at[k] : at[k + 1]] for v, at in lists.values())
                if own != last:
                    ended(size)
                    last, size, done, held, window = own, n, 0, [], np.zeros((0, len(x)))
                if i != done + len(held):
                    raise ValueError(f"{'two rows of values' if i < done + len(held) else 'genes without values before'}: {gene}, chunk {own[1]}")
                held.append((gene, l, dl, x, band))
                if len(held) == TILE or i == n - 1:
                    yield made()
        ended(size)

    white = joined.repartition(*key).sortWithinPartitions(*key, "i").mapInArrow(run, "chr string, chunk_id int, cut int, i long, gene string, x array<double>")
    if not sliced:
        return white.drop("cut")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cut", "x"))), lambda s: s["x"]))  # one row's own slices
    return white.groupBy("chr", "chunk_id", "i", "gene").agg(whole.alias("x"))


def _lanczos(n: int, times, steps: int) -> float:
    """The smallest Ritz value after ``steps`` steps, each made orthogonal to all before."""
    rng = np.random.default_rng(n)
    q = rng.normal(size=n)
    basis, alpha, beta = np.zeros((min(steps, n) + 1, n)), [], []
    basis[0] = q / np.linalg.norm(q)
    for k in range(min(steps, n)):
        w = times(basis[k])
        alpha.append(w @ basis[k])
        whole = basis[: k + 1]
        for _ in range(2):
            w = w - whole.T @ (whole @ w)
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(1.0, abs(alpha[0])):
            break
        basis[k + 1] = w / beta[-1]
    k = len(alpha)
    return float(np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))[0])


def _definite(tails: list[np.ndarray], diagonal: np.ndarray, band: int) -> bool:
    strips = Strips(band)
    try:
        for k in range(0, len(tails), TILE):
            strips.push(tails[k : k + TILE], diagonal[k : k + TILE])
    except np.linalg.LinAlgError:
        return False
    return True


def smallest_eigenvalue(tails: list[np.ndarray], diagonal: np.ndarray, steps: int = 96, tolerance: float = 1e-10) -> float:
    """Of the symmetric matrix of ragged rows: a Ritz value is never below it, and a factorisation of the matrix less that value
    (and a tolerance) proves that none is; where the proof fails, the value is bracketed by factorisations."""
    n = len(tails)
    size = np.array([len(t) for t in tails])
    rows = np.repeat(np.arange(n), size)
    cols = np.concatenate([np.arange(i - m, i) for i, m in enumerate(size)]) if n else rows
    values = np.concatenate([*tails, np.zeros(0)])

    def times(v: np.ndarray) -> np.ndarray:
        return diagonal * v + np.bincount(rows, values * v[cols], n) + np.bincount(cols, values * v[rows], n)

    high = _lanczos(n, times, steps)
    band, scale = int(size.max(initial=0)), max(1.0, float(np.abs(diagonal).max(initial=0)))
    if n <= steps or _definite(tails, diagonal - high + tolerance * scale, band):
        return high
    around = np.bincount(rows, np.abs(values), n) + np.bincount(cols, np.abs(values), n)
    low = float((diagonal - around).min()) - tolerance * scale
    while high - low > tolerance * scale:
        middle = (low + high) / 2
        low, high = (middle, high) if _definite(tails, diagonal - middle, band) else (low, middle)
    return (low + high) / 2


def _precision(tails: list[np.ndarray], diagonal: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """W W' for the ragged rows of a triangle W, with rows as ragged as W's, and its diagonal; it has the eigenvalues of W' W."""
    rows, out = [], []
    for tail, d in zip(tails, diagonal, strict=True):
        rows.append(np.append(tail, d))
        pairs = ((rows[-1][:-s], rows[-1 - s]) for s in range(len(tail), 0, -1))
        out.append(np.array([a[-min(len(a), len(b)) :] @ b[-min(len(a), len(b)) :] for a, b in pairs]))
    return out, np.array([w @ w for w in rows])


def smallest_eigenvalues(blocks: DataFrame, inverse: bool = False) -> DataFrame:
    """(chr, low) of each block; a task holds one block's ragged rows and their products' vectors.

    ``inverse``: blocks are given as rows (chr, i, l, dl) of their inverse
    factors, and the reciprocal of the inverse's largest eigenvalue is theirs.
    """

    def lowest(tails: list[np.ndarray], diagonal: np.ndarray) -> float:
        if not inverse:
            return smallest_eigenvalue(tails, diagonal)
        tails, diagonal = _precision(tails, diagonal)
        return -1.0 / smallest_eigenvalue([-t for t in tails], -diagonal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tails, diagonal = None, [], []
        row = lambda: pa.RecordBatch.from_pydict({"chr": [last], "low": [lowest(tails, np.array(diagonal))]})
        for batch in batches:
            values, at = _lists(batch.column("r"))
            for k, (chr_, d) in enumerate(zip(batch.column("chr").to_pylist(), batch.column("d").to_pylist(), strict=True)):
                if chr_ != last:
                    if tails:
                        yield row()
                    last, tails, diagonal = chr_, [], []
                tails.append(values[at[k] : at[k + 1]])
                diagonal.append(d)
        if tails:
            yield row()

    rows = blocks.select("chr", "i", F.col("l").alias("r"), F.col("dl").alias("d")) if inverse else blocks.select("chr", "i", "r", "d")
    return rows.repartition("chr").sortWithinPartitions("chr", "i").mapInArrow(run, "chr string, low double")

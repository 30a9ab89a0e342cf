"""Feature tables joined to the gene spine, imputed and laid out in column chunks.

Values stay in arrays: a file gives each gene one piece for each chunk that its
columns reach, pieces meet by gene and chunk in one shuffle, and no row stands
for a single value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .orthogonal import lists, matrix

POLICIES = ("raise", "ignore", "mean", "zero")


def feature_names(frames: list[DataFrame]) -> list[str]:
    """The features of wide frames whose first column is the gene, in the frames' order. A name that comes twice is an error."""
    names = [c for f in frames for c in f.columns[1:]]
    if len(set(names)) < len(names):
        raise ValueError(f"feature names come twice: {sorted({n for n in names if names.count(n) > 1})}")
    return names


def _cuts(frames: list[DataFrame], max_cols: int) -> list[list[tuple[int, int, list[str]]]]:
    """For each frame its pieces (chunk_id, place of the first in the chunk, columns)."""
    out, at = [], 0
    for f in frames:
        own, columns = [], f.columns[1:]
        while columns:
            room = max_cols - at % max_cols
            own.append((at // max_cols, at % max_cols, columns[:room]))
            at, columns = at + len(columns[:room]), columns[room:]
        out.append(own)
    return out


def pieces(frames: list[DataFrame], max_cols: int = 5000) -> DataFrame:
    """(gene, chunk_id, at, part): a frame's values of a gene within a chunk; ``at`` is the place of the first. NaN is null."""
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    parts = []
    for f, own in zip(frames, _cuts(frames, max_cols), strict=True):
        cut = F.array(*[F.struct(F.lit(chunk).alias("chunk_id"), F.lit(at).alias("at"), F.array(*[number(c) for c in columns]).alias("part")) for chunk, at, columns in own])
        if own:
            parts.append(f.select(F.col(f"`{f.columns[0]}`").cast("string").alias("gene"), F.explode(cut).alias("p")).select("gene", "p.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def repeated_genes(parts: DataFrame) -> DataFrame:
    """(gene, chunk_id, at) that a feature file lists more than once; only keys are shuffled."""
    return parts.groupBy("gene", "chunk_id", "at").count().where("count > 1").drop("count")


def on_spine(spine: DataFrame, frames: list[DataFrame], max_cols: int = 5000) -> DataFrame:
    """(chunk_id, row_idx, gene, x): each gene's values in a chunk, in column order; null where a file has no such gene.

    spine: (row_idx, gene). A gene that a file lists twice is an error.
    """
    expected: dict[int, list] = {}
    for chunk, at, columns in (piece for own in _cuts(frames, max_cols) for piece in own):
        expected.setdefault(chunk, []).append((at, len(columns)))
    if not expected:
        raise ValueError("there are no features")
    widths = spine.sparkSession.createDataFrame(list(expected.items()), "chunk_id int, expected array<struct<at: int, width: int>>")
    got = pieces(frames, max_cols).groupBy("chunk_id", "gene").agg(F.map_from_entries(F.collect_list(F.struct("at", "part"))).alias("got"))
    rows = spine.select("row_idx", "gene", F.explode(F.sequence(F.lit(0), F.lit(len(expected) - 1))).alias("chunk_id"))
    joined = rows.join(got, ["chunk_id", "gene"], "left").join(F.broadcast(widths), "chunk_id")  # a row for each chunk
    none = F.lit(None).cast("double")
    x = F.flatten(F.transform("expected", lambda e: F.coalesce(F.try_element_at("got", e["at"]), F.array_repeat(none, e["width"]))))
    return joined.select("chunk_id", "row_idx", "gene", x.alias("x"))


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the sums of its columns' values, and their counts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        ids = batch.column("chunk_id").to_numpy()
        for chunk in np.unique(ids).tolist():
            x = matrix(batch.column("x").filter(pa.array(ids == chunk)))  # null is NaN
            part = np.stack([np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)])
            total[chunk] = total[chunk] + part if chunk in total else part
    for chunk, (s, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), lists(s[None]), lists(n[None])], names=["chunk_id", "s", "n"])


def impute(chunks: DataFrame, policy: str = "raise") -> DataFrame:
    """Missing values of chunks by policy: an error, left null, the feature's mean over the spine, or 0."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    if policy == "raise":
        if chunks.where(F.exists("x", lambda v: v.isNull())).limit(1).count():
            raise ValueError("the feature matrix lacks genes")
    elif policy == "zero":
        return chunks.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    elif policy == "mean":
        summed = chunks.select("chunk_id", "x").mapInArrow(_column_sums, "chunk_id int, s array<double>, n array<double>")  # a row for each task and chunk
        per = summed.select("chunk_id", F.posexplode(F.arrays_zip("s", "n")).alias("pos", "v")).groupBy("chunk_id", "pos").agg(F.try_divide(F.sum("v.s"), F.sum("v.n")).alias("mean"))
        means = per.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("means"))
        return chunks.join(F.broadcast(means), "chunk_id").withColumn("x", F.zip_with("x", "means", lambda v, m: F.coalesce(v, m))).drop("means")  # a row for each chunk
    return chunks


def layout(features: DataFrame, max_cols: int = 5000) -> DataFrame:
    """(chunk_id, pos, col_idx, feature): chunks of max_cols columns, the rest in the last."""
    return features.select("col_idx", "feature").distinct().select(F.floor(F.col("col_idx") / max_cols).cast("int").alias("chunk_id"), (F.col("col_idx") % max_cols).cast("int").alias("pos"), "col_idx", "feature")


def numbered(df: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 by a column; for annotation tables, whose rows are few."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)) - 1)

"""A corpus pipeline of five stages: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.jobs.shipping import ship
from varve.llm import line_quality, ngram_join, packing, pseudonyms, substring_dedup
from varve.llm._tables import documents, dropped, kept, small_side


_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def extras_aside(stage):
    """The stage, with columns beyond those of documents under names that clash with none of an operator's."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prefix = "_extra_"
        while any(c.lower().startswith(prefix) for c in docs.columns):  # names differ by more than case
            prefix = f"_{prefix}"
        aside = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c not in _OWN}
        back = {v: k for k, v in aside.items()}
        return stage(spark, docs.withColumnsRenamed(aside), sf_dir).withColumnsRenamed(back)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@extras_aside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go, null and empty texts with them; repeated rows are judged each; an empty table stays empty."""
    ship(spark)
    return line_quality.retained(docs, line_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@extras_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of n-gram similarity connect, the one with the smallest doc_id stays.

    Of rows with one doc_id that of the smallest text stays. Rows without a
    doc_id take part after all others, in an order by a hash of their text, so
    equal ones are one document. An empty table stays empty.
    """
    ship(spark)
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)))
    rows = ngram_join.one_each(docs.withColumn("near_id", named), "near_id")
    found = ngram_join.join(rows.select(F.col("near_id").alias("doc_id"), "text"))
    gone = kept(found.where("component_id <> doc_id").select(F.col("doc_id").alias("near_id")), "gone")
    return rows.join(small_side(gone, "16"), "near_id", "left_anti").select(*docs.columns)


@extras_aside
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier in the corpus go from the text. Null texts stay null; rows equal in doc_id and text count as one; an empty table stays empty."""
    ship(spark)
    cut = substring_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


@extras_aside
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms. Null and empty texts stay as they are, as do repeated rows; an empty table stays empty."""
    return pseudonyms.pseudonymise(docs, pseudonyms.DEMO_KEY).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token sequences; a row for each piece. A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no row."""
    ship(spark)
    return packing.pack(docs, block_bytes=2 << 20, cache_bytes=12 << 20)  # beside what the stages before leave in the executors


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]

#: No SQL expresses the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, kept(stage(spark, docs, sf_dir), name)
        if k:
            dropped(before)  # the stage before wrote it, and this one has read it
    return docs

"""The text formats of annotations, gene statistics, targets and feature tables.

Rows keep their place in a file as an index, since later steps refer to it.
Files of genes are small (a line for each gene), so each is read as one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import deleted, new_path


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, line), without empty lines."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("row_idx", "line")).where(F.trim("line") != "")


def spaced(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns {name: type} of a white-space delimited file with a header, and row_idx from 0."""
    rows = lines(spark, path).select("row_idx", F.split(F.trim("line"), r"\s+").alias("f"))
    header = rows.orderBy("row_idx").first()["f"]
    if missing := [c for c in columns if c not in header]:
        raise ValueError(f"{path} lacks columns {missing}")
    body = rows.where("row_idx > 0")
    return body.select((F.col("row_idx") - 1).cast("long").alias("row_idx"), *[F.col("f")[header.index(c)].cast(kind).alias(c) for c, kind in columns.items()])


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, gene, chr, tss); the chromosome is text."""
    return spaced(spark, path, {"ENSGID": "string", "CHR": "string", "TSS": "double"}).toDF("row_idx", "gene", "chr", "tss")


def spine(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, gene) of a tab-delimited annotation."""
    rows = lines(spark, path).select("row_idx", F.split("line", "\t").alias("f"))
    at = rows.orderBy("row_idx").first()["f"].index("ENSGID")
    return rows.where("row_idx > 0").select((F.col("row_idx") - 1).cast("long").alias("row_idx"), F.col("f")[at].alias("gene"))


def gene_scores(spark: SparkSession, path: str) -> DataFrame:
    """(y_idx, gene, y) of a .genes.out file."""
    return spaced(spark, path, {"GENE": "string", "ZSTAT": "double"}).toDF("y_idx", "gene", "y")


def gene_correlations(spark: SparkSession, path: str) -> DataFrame:
    """(y_idx, gene, chr, nsnps, nparam, mac, r) of a .genes.raw file: two lines are skipped, r are the correlations with the genes just before, nearest last."""
    f = F.split("line", " ")
    rows = lines(spark, path).where("row_idx > 1").select((F.col("row_idx") - 2).cast("long").alias("y_idx"), f.alias("f"))
    number = lambda i: F.col("f")[i].cast("double")
    tail = F.transform(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))), lambda x: x.cast("double"))
    return rows.select("y_idx", F.col("f")[0].alias("gene"), F.col("f")[1].alias("chr"), number(4).alias("nsnps"), number(5).alias("nparam"), number(7).alias("mac"), tail.alias("r"))


def tabbed(spark: SparkSession, path: str) -> DataFrame:
    """A tab-delimited file with a header, all columns text."""
    return spark.read.csv(path, sep="\t", header=True)


def target(spark: SparkSession, path: str) -> DataFrame:
    """(y_idx, gene, y) of a custom target."""
    return spaced(spark, path, {"ENSGID": "string", "Score": "double"}).toDF("y_idx", "gene", "y")


def custom_covariates(spark: SparkSession, path: str) -> DataFrame:
    """(gene, c) of a custom covariate file."""
    df = tabbed(spark, path)
    return df.select(F.col("ENSGID").alias("gene"), F.array(*[F.col(f"`{c}`").cast("double") for c in df.columns if c != "ENSGID"]).alias("c"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(place, feature) of a list of features, one a token; a line for each of some features, so one task numbers them."""
    tokens = lines(spark, path).select("row_idx", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("at", "feature"))
    return tokens.select(F.row_number().over(Window.orderBy("row_idx", "at")).cast("long").alias("place"), "feature")


def joined(spark: SparkSession, folder: str, path: str, head: str = "") -> None:
    """One file of ``head`` and the part files of a folder, in the order of their names. It appears at ``path`` whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, half = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.unfinished")
    target = to.getFileSystem(conf)
    parts = jvm.org.apache.hadoop.fs.Path(folder)
    source = parts.getFileSystem(conf)
    out = target.create(half, True)
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(str(f.getPath()) for f in source.listStatus(parts) if f.getPath().getName().startswith("part-")):
            data = source.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)  # a stream: no part is held
            finally:
                data.close()
    finally:
        out.close()
    if target.exists(to):
        target.delete(to, True)
    if not target.rename(half, to):
        raise OSError(f"{path} can't be written")


def write_lines(df: DataFrame, order: str, value: str, path: str, head: str = "") -> None:
    """The file ``path`` of the text column ``value``, in the order of another one.

    Rows are dealt out by ranges of the order, sorted and written by many
    tasks; their parts are then joined.
    """
    spark, parts = df.sparkSession, new_path(df.sparkSession, "lines")
    ordered = df.select(F.col(f"`{order}`").alias("place"), F.col(f"`{value}`").alias("value")).repartitionByRange("place").sortWithinPartitions("place")
    ordered.select("value").write.text(parts)
    joined(spark, parts, path, head)
    deleted(spark, parts)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def feature_files(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The files of a folder, in the order of their names, without hidden ones."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [tabbed(spark, p) for p in sorted(str(f.getPath()) for f in found if not f.getPath().getName().startswith("."))]

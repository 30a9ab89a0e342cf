"""Result tables as tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import write_lines


def write_tsv(df: DataFrame, path: str, order: str) -> None:
    """The file ``path`` with a header, in the order of the column ``order``, which isn't written; missing values are empty, booleans True and False.

    A column called " " has a blank header. Many tasks write, see write_lines().
    """
    kinds, names = dict(df.dtypes), [c for c in df.columns if c != order]
    text = [F.when(F.col(f"`{c}`"), "True").when(~F.col(f"`{c}`"), "False") if kinds[c] == "boolean" else F.col(f"`{c}`").cast("string") for c in names]
    line = F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in text]), "\t")
    write_lines(df.select(F.col(f"`{order}`").alias("place"), line.alias("value")), "place", "value", path, "\t".join("" if n == " " else n for n in names) + "\n")

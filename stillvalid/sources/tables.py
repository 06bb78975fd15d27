"""Reading tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def decimal_text(column: str, decimal: str) -> F.Column:
    text = F.trim(F.col(column))
    return F.regexp_replace(text, f"\\{decimal}", ".") if decimal != "." else text


def read_csv(spark: SparkSession, path: str, numeric: Sequence[str], *, sep: str = ",",
             decimal: str = ".", keep: Sequence[str] | None = None,
             header: bool = True) -> DataFrame:
    """Delimited text with a chosen decimal mark, projected to ``keep``.

    Columns arrive as text (no inference pass over the files); ``numeric`` ones are converted and an
    unreadable number becomes NULL.
    """
    raw = spark.read.option("header", header).option("sep", sep).csv(path)
    wanted = list(keep) if keep else raw.columns
    return raw.select(*[
        decimal_text(c, decimal).try_cast("double").alias(c) if c in numeric else F.col(c)
        for c in wanted])


def write_results(df: DataFrame, path: str, *, fmt: str = "parquet", overwrite: bool = False,
                  partition_by: Sequence[str] = ()) -> None:
    """Write a result table; an existing one is left alone unless ``overwrite`` is set."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)

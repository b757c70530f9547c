"""What the training-data operators share: input tables, row numbers, Arrow helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import new_path

# Row number that ``numbered`` adds; callers' columns never carry this name further.
ROW = "_row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``df`` and a number ``_row`` that tells repeated rows apart.

    The numbers differ between evaluations of an arbitrary plan, so the rows are
    written once and every later step reads them back.
    """
    return written(df.select(*columns, F.monotonically_increasing_id().alias(ROW)), "rows")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, closely packed, and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

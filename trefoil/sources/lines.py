"""Text files whose line order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import materialise

_BLOCK = ["_path", "_start"]


def numbered_lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """``(line, value)``: every record of the text files with its 1-based number.

    Files count in path order. The text is not sorted: inside one input split
    rows arrive in file order, so the number is the row's place in its split plus
    the records of all splits before it. Those are summed in two levels, over the
    splits of each file and over the files, and only one row per file meets in one
    task. The table of splits is written, so Spark knows its size when it chooses
    how to join: it is sent to all tasks while that is below the session's
    threshold, and beyond both sides are shuffled by split.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    rows = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    counts = rows.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    counts = materialise(counts, "splits")
    earlier = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    files = counts.groupBy("_path").agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_path", F.coalesce(before, F.lit(0)).alias("_files"))
    splits = counts.withColumn("_in_file", F.coalesce(earlier, F.lit(0))).join(files, "_path")
    splits = materialise(splits.select(*_BLOCK, "_first", (F.col("_files") + F.col("_in_file")).alias("_before")), "splits")
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return rows.join(splits, _BLOCK).select(number.alias("line"), "value")


def zip_lines(spark: SparkSession, left, right) -> DataFrame:
    """``(line, left, right)``: line i of one text with line i of the other."""
    a = numbered_lines(spark, left).withColumnRenamed("value", "left")
    b = numbered_lines(spark, right).withColumnRenamed("value", "right")
    return a.join(b, "line")

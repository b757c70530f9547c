"""Result tables of executed workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.querytext import NAME_MARKER, TIME_MARKER

# Columns of a result line, in file order.
RUN_SCHEMA = (
    "query string, num_results long, time_ms double, table_sizes long, reduction_sizes long, "
    "max_joins int, is_warm boolean, num_triples int"
)
RUN_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


def write_runs(runs: DataFrame, path: str) -> None:
    """Tab-separated result lines, without a header."""
    runs.select(*RUN_COLUMNS).write.mode("overwrite").csv(path, sep="\t")


def read_runs(spark: SparkSession, path) -> DataFrame:
    """Result lines with ``query_id``, the number before the name marker."""
    runs = spark.read.schema(RUN_SCHEMA).csv(path, sep="\t")
    number = F.substring_index("query", NAME_MARKER, 1)
    return runs.select(number.try_cast("long").alias("query_id"), *RUN_COLUMNS)


def read_times(spark: SparkSession, path) -> DataFrame:
    """``(query_id, time_ms)`` of another system: ``id<TAB>time [marker...`` lines."""
    part = F.split("value", "\t")
    return spark.read.text(path).select(
        F.trim(part[0]).cast("long").alias("query_id"),
        F.substring_index(part[1], TIME_MARKER, 1).cast("double").alias("time_ms"),
    )

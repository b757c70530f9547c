"""Comparing the run times of two systems over one workload.

``runs`` follows the run table (``query_id``, ``time_ms``, ``num_triples``,
``max_joins``, ``is_warm``); ``other`` is ``(query_id, time_ms)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.querytext import query_class
from ..operators.numbering import global_rank


def mean_time_by_class(runs: DataFrame) -> DataFrame:
    return runs.groupBy(query_class("query_id").alias("query_class")).agg(F.avg("time_ms").alias("mean_ms"))


def _mean_by(runs: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Mean times of both systems; the other's queries take the column by id."""
    own = runs.groupBy(column).agg(F.avg("time_ms").alias("mean_ms"))
    known = runs.select("query_id", column).distinct()
    theirs = other.join(known, "query_id").groupBy(column).agg(F.avg("time_ms").alias("other_mean_ms"))
    return own.join(theirs, column, "left")


def mean_time_by_size(runs: DataFrame, other: DataFrame) -> DataFrame:
    """``(num_triples, mean_ms, other_mean_ms)``."""
    return _mean_by(runs, other, "num_triples")


def mean_time_by_joins(runs: DataFrame, other: DataFrame) -> DataFrame:
    """``(max_joins, mean_ms, other_mean_ms)`` of warm queries."""
    return _mean_by(runs.where("is_warm"), other, "max_joins")


def cold_queries(runs: DataFrame, other: DataFrame) -> DataFrame:
    """``(query_id, time_ms, other_time_ms)`` of queries that computed a reduction."""
    cold = runs.where(~F.col("is_warm")).select("query_id", "time_ms")
    return cold.join(other.select("query_id", F.col("time_ms").alias("other_time_ms")), "query_id", "left")


def rank_aligned(
    runs: DataFrame, other: DataFrame, key: str = "query_id", time: str = "time_ms", ascending: bool = False
) -> DataFrame:
    """``(rank, time_ms, other_time_ms)``: both systems' times sorted and paired.

    ``key`` breaks ties. Ranks that only the longer list has come with a null
    for the other time.
    """
    def ranked(df, name):
        order = F.col(time).asc() if ascending else F.col(time).desc()
        return global_rank(df.select(key, time), order, F.col(key)).select("rank", F.col(time).alias(name))

    return ranked(runs, "time_ms").join(ranked(other, "other_time_ms"), "rank", "full")

"""Counts that describe a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .graph import Graph


def properties(g: Graph) -> DataFrame:
    return g.triples.select("prop").distinct()


def value_counts(g: Graph) -> DataFrame:
    """``(prop, side, value, n)``: every distinct value of every column with its rows.

    Values are counted on the map side, so a hot one is a row for each task.
    """
    ends = F.inline(F.array(
        F.struct(F.lit("sub").alias("side"), F.col("sub").alias("value")),
        F.struct(F.lit("obj").alias("side"), F.col("obj").alias("value")),
    ))
    return g.triples.select("prop", ends).groupBy("prop", "side", "value").agg(F.count(F.lit(1)).alias("n"))


def stats_of_values(values: DataFrame) -> DataFrame:
    """Property statistics from distinct values: two numbers a column are all that is shuffled."""
    sides = values.groupBy("prop", "side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("n_values")))
    return _with_ratio(sides.groupBy("prop").agg(F.max("n").alias("n"), of("sub").alias("n_sub"), of("obj").alias("n_obj")))


def property_stats(g: Graph, approx: bool = False) -> DataFrame:
    """``(prop, n, n_sub, n_obj, ratio)`` for every property.

    A stored graph answers from its distinct values. ``approx`` replaces the exact
    distinct counts by HyperLogLog estimates, which need no shuffle of the values.
    """
    if approx:
        return _with_ratio(g.triples.groupBy("prop").agg(
            F.count(F.lit(1)).alias("n"), F.approx_count_distinct("sub").alias("n_sub"), F.approx_count_distinct("obj").alias("n_obj")))
    return stats_of_values(g.distinct if g.distinct is not None else value_counts(g))


def _with_ratio(per_prop: DataFrame) -> DataFrame:
    # The window runs over one row per property.
    total = F.sum("n").over(Window.partitionBy())
    return per_prop.withColumn("ratio", F.col("n") / total)


def graph_stats(g: Graph, approx: bool = False) -> DataFrame:
    """One row: number of triples, properties, distinct subjects and objects."""
    distinct = F.approx_count_distinct if approx else F.countDistinct
    return g.triples.agg(
        F.count(F.lit(1)).alias("n_triples"),
        F.countDistinct("prop").alias("n_properties"),
        distinct("sub").alias("n_sub"),
        distinct("obj").alias("n_obj"),
    )

"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``component`` (the smallest node reached) for every node of an edge.

    Each round ties all larger neighbours of a node to its smallest neighbour,
    then all smaller ones, until stars remain. A round is written to the shared
    folder, so lineage stays short; only edge counts and check sums reach the
    driver. Both sides of each join are plain scans or shuffles of written rows,
    which lets Spark divide the neighbours of a very large star.
    """
    e = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()
    e = written(e, "edges")

    def print_of(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    before = print_of(e)
    while before[0]:
        # Large star: neighbours above a node join the smallest of its neighbours and itself.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = written(large, "edges")
        # Small star: a node and its neighbours below it join the smallest of them.
        below = written(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(below, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("u < v")
        e = written(small.select("u", "v").distinct(), "edges")
        now = print_of(e)
        if now == before:
            break
        before = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )

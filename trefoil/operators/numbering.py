"""Numbering rows of large tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import materialise

# monotonically_increasing_id() keeps the partition above this many bits.
_ROW_BITS = 33


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the order given.

    The sort is range-partitioned over all tasks and written once; a row's rank
    is its place in its partition plus the rows of the partitions before. Only
    the partition sizes meet in one task; they are written, one row each, so Spark
    knows their size when it chooses how to join them.
    ``order`` should end in a unique column.
    """
    placed = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("_part", F.shiftright("_row", _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")), "starts")
    place = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(starts, "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .select(*df.columns, name)
    )


def repeat_rows(df: DataFrame, times: str, block: int = 65536) -> DataFrame:
    """Emit every row ``times`` times (column of counts) and drop that column.

    Two nested explodes bound the helper arrays to ``block`` elements each.
    """
    n = F.col(times)
    blocks = df.where(n > 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("long"))))
    inside = F.least(F.lit(block), n - F.col("_b") * block).cast("long")
    return blocks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), inside))).drop(times, "_b", "_i")

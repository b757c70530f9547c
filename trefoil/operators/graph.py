"""The graph handle: triples, property tables, stored statistics and filters."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.terms import as_column
from .numbering import global_rank
from ..sources.shared import materialise
from ..sources.triples import read_vp, write_vp


class Graph:
    """A bag of ``(sub, prop, obj)`` triples.

    ``triples`` may be any DataFrame with those columns: a stored graph (see
    :meth:`load`), parsed text, or a view over relational tables. The others
    are optional companions that a stored graph has; operators that need them
    build them when they are absent, but for ``heavy``, without which joins on
    heavy values are not divided.
    """

    def __init__(
        self, triples: DataFrame, stats: DataFrame | None = None, blooms=None, distinct: DataFrame | None = None,
        heavy: DataFrame | None = None,
    ):
        self.triples = triples.select("sub", "prop", "obj")
        self.spark: SparkSession = triples.sparkSession
        self.stats = stats
        self.blooms = blooms
        # Distinct values with their counts ``(prop, side, value, n)``, and those that hold much of their column.
        self.distinct = distinct
        self._heavy_table = heavy
        self._heavy: dict[tuple[str | None, str], list[tuple[str, int, int]]] | None = None
        self._sizes: dict[str, tuple[int, int, int]] = {}
        self._values: dict[tuple[str, str], DataFrame] = {}

    def prop(self, p: str) -> DataFrame:
        """One property table ``(sub, obj)``; reads only that property's data."""
        return self.triples.where(F.col("prop") == p).select("sub", "obj")

    def save(
        self, path: str, fpp: float | None = None, partitions: int | None = None, least_heavy: int | None = None
    ) -> "Graph":
        """Write triples, distinct values, property statistics, heavy values and (with ``fpp``) Bloom filters.

        The distinct values are the one aggregate over all triples; the rest is
        computed from them. ``least_heavy`` is the least number of rows of a heavy value.
        """
        from .bloom import build_blooms, save_blooms
        from .division import LEAST_ROWS, heavy_rows
        from .statistics import stats_of_values, value_counts

        write_vp(self.triples, f"{path}/triples", partitions)
        stored = Graph(read_vp(self.spark, f"{path}/triples"))
        # Clustered by column, so that a column's values are a few files; a large column is divided.
        counts = value_counts(stored).hint("rebalance", "prop", "side")
        counts.write.mode("overwrite").partitionBy("prop", "side").parquet(f"{path}/values")
        stored.distinct = _stored_values(self.spark, path)
        stats_of_values(stored.distinct).write.mode("overwrite").parquet(f"{path}/stats")
        stored.stats = self.spark.read.parquet(f"{path}/stats")
        # Few rows, merged behind a shuffle: merged without one, a single task would scan all distinct values.
        heavy = heavy_rows(stored.distinct, least=LEAST_ROWS if least_heavy is None else least_heavy)
        heavy.hint("rebalance").write.mode("overwrite").parquet(f"{path}/heavy")
        if fpp is not None:
            save_blooms(build_blooms(stored, fpp), f"{path}/blooms")
        return Graph.load(self.spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Graph":
        from .bloom import load_blooms
        from ..sources.shared import exists

        stats = spark.read.parquet(f"{path}/stats") if exists(spark, f"{path}/stats") else None
        blooms = load_blooms(spark, f"{path}/blooms") if exists(spark, f"{path}/blooms") else None
        distinct = _stored_values(spark, path) if exists(spark, f"{path}/values") else None
        heavy = spark.read.parquet(f"{path}/heavy") if exists(spark, f"{path}/heavy") else None
        return cls(read_vp(spark, f"{path}/triples"), stats, blooms, distinct, heavy)

    def heavy(self, p: str | None, side: str) -> list[tuple[str, int, int]]:
        """``(value, rows, rows of the column)`` of the heavy values of a column; ``None`` is any property.

        At most a fixed number a column (see ``division``), looked up once.
        """
        if self._heavy is None:
            self._heavy = {}
            for r in self._heavy_table.collect() if self._heavy_table is not None else ():
                self._heavy.setdefault((r["prop"], r["side"]), []).append((r["value"], r["n"], r["total"]))
        return self._heavy.get((p, side), [])

    def sizes(self, props) -> dict[str, tuple[int, int, int]]:
        """(rows, distinct subjects, distinct objects) of the given properties.

        A few numbers per property asked for, kept with the graph. They come
        from the stored statistics, else from one job over those properties.
        """
        from .statistics import property_stats

        missing = [p for p in dict.fromkeys(props) if p not in self._sizes]
        if missing:
            wanted = F.col("prop").isin(missing)
            stats = self.stats if self.stats is not None else property_stats(Graph(self.triples.where(wanted)))
            found = stats.where(wanted).select("prop", "n", "n_sub", "n_obj")
            self._sizes.update(dict.fromkeys(missing, (0, 0, 0)))
            self._sizes.update({r["prop"]: (r["n"], r["n_sub"], r["n_obj"]) for r in found.collect()})
        return {p: self._sizes[p] for p in dict.fromkeys(props)}

    def values(self, p: str, side: str) -> DataFrame:
        """Distinct values of one column of a property: the stored ones, else written once for the graph.

        Joined with the written table, the other side of a semi-join is a bare
        shuffle, which lets adaptive execution divide a hot value; a join with
        the aggregate itself could not be divided.
        """
        if self.distinct is not None:
            of = (F.col("prop") == p) & (F.col("side") == side)
            return self.distinct.where(of).select(F.col("value").alias(side))
        if (p, side) not in self._values:
            self._values[p, side] = materialise(self.prop(p).select(side).distinct(), "values")
        return self._values[p, side]

    def counts(self, props) -> dict[str, int]:
        """Rows of the given properties."""
        return {p: size[0] for p, size in self.sizes(props).items()}

    def place(self, by: str = "sub", level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "Graph":
        """Cache the triples clustered and sorted by one column.

        The rebalance hint clusters like a repartition but lets adaptive
        execution divide the partition of a hot value.
        """
        placed = self.triples.hint("rebalance", by).sortWithinPartitions(by).persist(level)
        return Graph(placed, self.stats, self.blooms, self.distinct, self._heavy_table)


def _stored_values(spark: SparkSession, path: str) -> DataFrame:
    schema = "value string, n long, prop string, side string"
    return spark.read.schema(schema).parquet(f"{path}/values").select("prop", "side", "value", "n")


def compact_property(g: Graph, p: str, max_items: int) -> DataFrame:
    """``(sub, part, <p>)``: the sorted objects of each subject as one array.

    A subject with more than ``max_items`` objects comes back as several parts
    of at most that size, so no task and no row holds an unbounded list; all
    others have the single part 0. Parts are ranges of the sorted objects: one
    after the other they are the one sorted array.
    """
    # A distributed sort ranks all rows; the first rank of each subject turns that into places within it.
    ranked = global_rank(g.prop(p), "sub", "obj", name="_rank")
    firsts = materialise(ranked.groupBy("sub").agg(F.min("_rank").alias("_first")), "firsts")
    part = F.floor((F.col("_rank") - F.col("_first")) / max_items)
    return (
        ranked.join(firsts, "sub")
        .withColumn("part", part.cast("int"))
        .groupBy("sub", "part")
        .agg(F.array_sort(F.collect_list("obj")).alias(p))
    )


def union_properties(g: Graph, props) -> DataFrame:
    """Bag union of property tables that keeps each row's property."""
    return g.triples.where(F.col("prop").isin(list(props)))


def exclude(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is not listed: a Python list or a one-column DataFrame."""
    if isinstance(values, DataFrame):
        listed = values.toDF(column).distinct()
        return df.join(listed, column, "left_anti")
    return df.where(~as_column(column).isin(list(values)))

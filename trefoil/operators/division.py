"""Joins on values that hold a large share of a column's rows.

A value is heavy in a (property, side) if it holds at least ``1 / SHARE`` of the
rows; so no column has more than ``SHARE`` of them, whatever its size. Light values
take the plain join. Rows of a heavy value are dealt over salts on one side of the
join and copied for every salt on the other: each pair still meets once. A
variable keeps its salt for all later joins on it, so the tables of a star are
shuffled once each, by (variable, salt), however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Most heavy values of a column; salts for each partition that a heavy value would fill, and rows for each salt at least.
SHARE = 256
SALTS = 16
DEALT_ROWS = 100
# Fewer rows than this are no load for a task.
LEAST_ROWS = 100_000


def heavy_rows(values: DataFrame, share: int = SHARE, least: int = LEAST_ROWS) -> DataFrame:
    """``(prop, side, value, n, total)`` of the heavy values, from distinct values with their counts.

    A null property stands for the whole graph.
    """
    columns = ["prop", "side", "value", "n", "total"]
    totals = values.groupBy("prop", "side").agg(F.sum("n").alias("total"))
    within = values.where(F.col("n") >= least).join(totals, ["prop", "side"]).where(F.col("n") * share >= F.col("total"))
    triples, props = totals.where("side = 'sub'").agg(F.sum("total"), F.count(F.lit(1))).first()
    # A value heavy in the graph holds its part of that in one property at least; only such values are summed up.
    enough = max(least, (triples or 0) / share)
    likely = values.where(F.col("n") * max(props, 1) >= enough).select("side", "value").distinct()
    whole = values.join(likely, ["side", "value"], "left_semi").groupBy("side", "value").agg(F.sum("n").alias("n"))
    whole = whole.where(F.col("n") >= enough).select(
        F.lit(None).cast("string").alias("prop"), "side", "value", "n", F.lit(triples or 0).cast("long").alias("total"))
    return within.select(columns).unionByName(whole)


class Division:
    """Salts of the variables of one growing join."""

    def __init__(self, g):
        self.partitions = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
        self.g = g
        # Variable to its salts by value; the column of its salt exists in the rows if there are any.
        self.salts: dict[str, dict[str, int]] = {}

    def heavy(self, pattern, v: str) -> dict[str, int]:
        """Number of salts for each heavy value of a variable in one pattern."""
        s, p, o = pattern
        found: dict[str, int] = {}
        for side, term in (("sub", s), ("obj", o)):
            if term == f"?{v}":
                for value, n, total in self.g.heavy(None if p.startswith("?") else p, side):
                    salts = math.ceil(SALTS * self.partitions * n / total)
                    found[value] = max(found.get(value, 0), min(salts, SALTS * self.partitions))
        return found

    @staticmethod
    def column(v: str) -> str:
        return f"_salt_{v}"

    def join(self, rows: DataFrame, table: DataFrame, keys: list[str], before, pattern, summed: bool = False, merged: bool = False) -> DataFrame:
        """Join on ``keys``; ``before`` are the patterns in ``rows``, ``pattern`` is that of ``table``.

        A ``summed`` table, or ``merged`` rows, have one row for each value: nothing in them is heavy.
        """
        if len(keys) != 1:
            # Values that agree in two variables are not known; those of one variable already dealt help.
            return rows.join(table, keys)
        v = keys[0]
        known = self.salts.get(v)
        new: dict[str, int] = {}
        if known is None:
            known = {}
            for q in () if merged else before:
                for value, n in self.heavy(q, v).items():
                    known[value] = max(known.get(value, 0), n)
            if known:
                rows = rows.withColumn(self.column(v), _dealt(rows, v, known))
        if not summed:
            new = {value: n for value, n in self.heavy(pattern, v).items() if value not in known}
        if not known and not new:
            return rows.join(table, keys)
        salt = self.column(v)
        # Heavy on the left alone or on both sides: dealt there, copied here. Heavy here alone: the other way round.
        held = F.col(salt) if salt in rows.columns else F.lit(0)
        if new:
            rows = rows.withColumn(salt, F.explode(F.when(F.col(v).isin(list(new)), _salts(v, new)).otherwise(F.array(held))))
            dealt = _dealt(table, v, new)
        else:
            dealt = F.lit(0)
        if known:
            copies = F.when(F.col(v).isin(list(known)), _salts(v, known)).otherwise(F.array(dealt))
            table = table.withColumn(salt, F.explode(copies))
        else:
            table = table.withColumn(salt, dealt)
        self.salts[v] = {**known, **new}
        return rows.join(table, [v, salt])

    def extra(self, columns) -> list[str]:
        """Salt columns among ``columns``."""
        return [c for c in columns if c in {self.column(v) for v in self.salts}]


def _number(v: str, salts: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in salts.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col(v))


def _salts(v: str, salts: dict[str, int]) -> Column:
    return F.sequence(F.lit(0), _number(v, salts) - 1)


def _dealt(df: DataFrame, v: str, salts: dict[str, int]) -> Column:
    """A salt for each row: the same whenever the row is computed again, also for copies of a row in another partition."""
    place = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), _number(v, salts)).cast("int")
    return F.when(F.col(v).isin(list(salts)), place).otherwise(0)

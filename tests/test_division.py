"""Joins on heavy values: the same answers, and no task that holds a heavy value."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trefoil import Graph, bgp, bgp_count, bgp_grouped, property_stats
from trefoil.operators.division import heavy_rows
from trefoil.operators.statistics import value_counts

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture(scope="module")
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def star(spark, settings, tmp_path_factory):
    """One subject on 80 % of the rows of ``p`` and ``big``; its few rows in ``q`` and ``r``; one object on 80 % of ``o``."""
    ids = spark.range(0, 60_000, 1, 8)
    hot = F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("s"), "id"))
    value = lambda name: F.concat(F.lit(name), F.col("id").cast("string"))
    few = ids.where("id % 5 = 0")
    parts = [
        ids.select(hot.alias("sub"), F.lit("p").alias("prop"), value("x").alias("obj")),
        few.select(value("s").alias("sub"), F.lit("q").alias("prop"), value("y").alias("obj")),
        few.select(value("s").alias("sub"), F.lit("r").alias("prop"), value("z").alias("obj")),
        spark.createDataFrame([("hot", "q", "y"), ("hot", "q", "y"), ("hot", "r", "z")], "sub string, prop string, obj string"),
        ids.select(value("t").alias("sub"), F.lit("o").alias("prop"), hot.alias("obj")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return Graph(rows).save(str(tmp_path_factory.mktemp("star") / "g"), least_heavy=1000)


def sizes(df):
    """Rows of each task of the last stage."""
    found = dict(df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sorted(found.values())


def even(df):
    rows = sizes(df)
    assert len(rows) > 4 and rows[-1] <= 2 * statistics.median(rows), rows


def test_heavy_values_are_found(star):
    assert [v for v, _, _ in star.heavy("p", "sub")] == ["hot"]
    assert star.heavy("p", "sub")[0][1:] == (48_000, 60_000)
    assert not star.heavy("q", "sub") and not star.heavy("p", "obj")
    assert [v for v, _, _ in star.heavy(None, "sub")] == ["hot"]


def test_star(star):
    patterns = [("?a", "p", "?x"), ("?a", "q", "?y"), ("?a", "r", "?z")]
    found = bgp(star, patterns)
    assert found.columns == ["a", "x", "y", "z"]
    assert found.count() == 48_000 * 2 + 12_000
    even(found)


def test_star_in_any_order(star):
    patterns = [("?a", "q", "?y"), ("?a", "r", "?z"), ("?a", "p", "?x")]
    found = bgp(star, patterns, stats={})
    assert found.count() == 48_000 * 2 + 12_000
    even(found)


def test_chain(star):
    found = bgp(star, [("?t", "o", "?a"), ("?a", "p", "?x")], select=["?t"])
    # The heavy object of one meets the heavy subject of the other: only its light values are counted here.
    light = found.where("t like 't%0' or t like 't%5'")
    assert light.count() == 12_000


def test_object_side(star):
    found = bgp(star, [("?t", "o", "?a"), ("?a", "q", "?y")])
    assert found.count() == 48_000 * 2 + 12_000
    even(found)


@pytest.mark.parametrize("patterns, n", [
    ([("?a", "p", "?x"), ("?a", "q", "?y")], 48_000 * 2 + 12_000),
    ([("?a", "p", "?x"), ("?b", "o", "?a")], 48_000 * 48_000 + 12_000),
    ([("?a", "p", "?x"), ("?a", "q", "?y"), ("?a", "r", "?z")], 48_000 * 2 + 12_000),
    ([("?a", "?f", "?x"), ("?a", "?g", "?y")], (48_000 + 3) ** 2 + 12_000 * 9 + 60_000),
])
def test_counts(star, patterns, n):
    assert bgp_count(star, patterns).first()["n"] == n


def test_counted_join_is_even(star):
    """The rows of a heavy value are summed by salt, on all tasks."""
    grouped = bgp_grouped(star, [("?a", "p", "?x"), ("?a", "q", "?y")], ["?x"])
    assert grouped.agg(F.sum("n")).first()[0] == 48_000 * 2 + 12_000
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "_salt_a" in plan


def test_brute_force(spark, solve, tmp_path):
    """Random small graphs in which everything is heavy."""
    draw = random.Random(11)
    for k in range(4):
        triples = [(draw.choice("aab"), draw.choice("pqp"), draw.choice("aabc")) for _ in range(14)]
        g = Graph(spark.createDataFrame(triples, "sub string, prop string, obj string")).save(str(tmp_path / str(k)), least_heavy=1)
        assert g.heavy("p", "sub")
        terms = ["?x", "?y", "?z", "a"]
        for _ in range(4):
            patterns = [(draw.choice(terms), draw.choice(["p", "q", "?r"]), draw.choice(terms)) for _ in range(3)]
            names = list(dict.fromkeys(t[1:] for p in patterns for t in p if t.startswith("?")))
            answers = solve(triples, patterns)
            rows = Counter(tuple(r[n] for n in names) for r in bgp(g, patterns, allow_cross=True).collect())
            assert rows == Counter(tuple(a[f"?{n}"] for n in names) for a in answers), patterns
            assert bgp_count(g, patterns, allow_cross=True).first()["n"] == len(answers), patterns
            by = names[:1]
            grouped = bgp_grouped(g, patterns, [f"?{n}" for n in by], allow_cross=True, count_as="_k")
            assert {tuple(r[n] for n in by): r["_k"] for r in grouped.collect()} == Counter(tuple(a[f"?{n}"] for n in by) for a in answers)


def test_heavy_in_the_whole_graph_only(spark):
    """A value spread over many properties is heavy in none of them, but in the graph."""
    triples = [(f"s{i}" if i % 300 else "hub", f"p{i // 300}", "o") for i in range(30_000)]
    values = value_counts(Graph(spark.createDataFrame(triples, "sub string, prop string, obj string")))
    found = {(r["prop"], r["value"]): r["n"] for r in heavy_rows(values, least=1).where("side = 'sub'").collect()}
    assert found == {(None, "hub"): 100} or (None, "hub") not in found
    found = {(r["prop"], r["value"]): r["n"] for r in heavy_rows(values, share=300, least=1).where("side = 'sub'").collect()}
    assert found[None, "hub"] == 100


def test_one_aggregate_over_the_triples(star):
    """Statistics and values of a stored graph read its distinct values, not its triples."""
    for df in (property_stats(star), star.values("p", "sub")):
        assert not any("/triples" in f for f in df.inputFiles())
    assert {r["prop"]: (r["n"], r["n_sub"], r["n_obj"]) for r in property_stats(star).collect()}["p"] == (60_000, 12_001, 60_000)


def test_heavy_values_are_found_by_many_tasks(spark, settings, tmp_path):
    """Saving does not squeeze the search of heavy values into one task: unmerged, it leaves several files."""
    triples = spark.range(0, 2000, 1, 8).select(
        F.concat(F.lit("s"), F.col("id") % 50).alias("sub"), F.lit("p").alias("prop"), F.concat(F.lit("o"), F.col("id") % 40).alias("obj"))
    g = Graph(triples).save(str(tmp_path / "g"), least_heavy=1)
    assert len(g.heavy("p", "sub")) == 50 and len(g.heavy("p", "obj")) == 40
    assert len(g._heavy_table.inputFiles()) > 1

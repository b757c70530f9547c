"""A value on most rows is divided by adaptive skew handling."""

import pytest
from pyspark.sql import functions as F


from trefoil import Graph
from trefoil.functions.signatures import signature_text
from trefoil.operators.reduction import marked_property, semi_join
from trefoil.operators.unbound import candidate_properties_by_join

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    rows = spark.range(0, 200_000, 1, 16).select(
        F.when(F.col("id") % 5 > 0, "hot").otherwise(F.col("id").cast("string")).alias("sub"), F.lit("p").alias("prop"),
        F.sha2(F.col("id").cast("string"), 256).alias("obj"))
    partners = spark.range(0, 200_000, 50).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("sub"), F.lit("q").alias("prop"), F.lit("x").alias("obj"))
    yield Graph(rows.union(partners))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def divided(df):
    """Whether the plan that ran has a divided join."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_reduction(hot):
    reduced = semi_join(hot.prop("p"), "sub", hot, ("q", "sub"))
    assert reduced.count() == 160_000 + len([i for i in range(50, 200_000, 50)])
    assert divided(reduced)


def test_marked(hot):
    assert divided(marked_property(hot, "p", [signature_text(("p", "sub"), [("q", "sub")])]))


def test_candidates(hot):
    values = hot.prop("q").select("sub")
    found = candidate_properties_by_join(hot, values, "sub")
    assert sorted(r["prop"] for r in found.collect()) == ["p", "q"]
    assert divided(found)

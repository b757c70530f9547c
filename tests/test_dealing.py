"""The warehouse workload is dealt by its size, not by the session's number of partitions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import trefoil as t
from trefoil.sources import warehouse

LINES = 4000


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warehouse, "TASK_LINES", 100, raising=False)
    # Orders of four lines; each sixteenth line comes twice, some keys are null, part 3 is there twice.
    line = spark.range(LINES).select(
        F.when(F.col("id") % 401 != 0, F.floor(F.col("id") / 4)).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        F.when(F.col("id") % 97 != 0, F.col("id") % 50).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"))
    line.union(line.where("l_linenumber = 0 and l_orderkey % 4 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = spark.range(50).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("p_brand"))
    part.union(part.where("p_partkey = 3")).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_rows(spark, folder):
    lines = {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect():
        key = (r["l_orderkey"], r["l_linenumber"], r["l_partkey"])
        lines[key] = min(lines.get(key, r["l_suppkey"]), r["l_suppkey"])
    expected = Counter()
    for (order, number, part), supplier in lines.items():
        if part is not None:
            ends = ("?v0", f"?s{supplier}") if number % 2 else (f"?s{supplier}", "?v0")
            query = None if order is None else order + 1
            expected[query, query, part * 8 + number, ends[0], f"b{part % 5}", ends[1]] += 1 + (part == 3)
    assert Counter(map(tuple, warehouse.workload(spark, folder).collect())) == expected


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_task_holds_a_bounded_number_of_lines(spark, folder, threshold):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k in names:
            spark.conf.set(k, threshold)
        rows = warehouse.workload(spark, folder).groupBy(F.spark_partition_id().alias("task")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries")).collect()
        assert max(r["n"] for r in rows) <= 300
        # A query lies in one task.
        assert sum(r["queries"] for r in rows) == warehouse.workload(spark, folder).where("query_id is not null").select("query_id").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_aggregates_by_query_move_no_rows(spark, folder):
    features = t.query_features(warehouse.workload(spark, folder))
    features.collect()
    assert features._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1

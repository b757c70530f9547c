"""Filters, reductions and candidate properties."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import trefoil as t
from trefoil import Graph
from trefoil.operators.bloom import bloom_filter_rows, build_blooms
from trefoil.operators.reduction import Reductions, partner_sides

CHAIN = [("?x", "friends", "?y"), ("?y", "lives", "?z")]


def test_object_filter_holds_objects(social):
    blooms = t.build_blooms(social, fpp=0.001)
    cities = social.prop("lives").select(F.col("obj").alias("v"))
    people = social.prop("lives").select(F.col("sub").alias("v"))
    objects = blooms.of(("lives", "obj"))
    assert bloom_filter_rows(cities, "v", objects).count() == 3
    assert bloom_filter_rows(people, "v", objects).count() == 0


def test_no_false_negatives_and_rate(spark):
    n = 30_000
    rows = spark.range(n).select(F.concat(F.lit("in/"), "id").alias("sub"), F.lit("p").alias("prop"), F.lit("o").alias("obj"))
    g = Graph(rows)
    others = spark.range(n).select(F.concat(F.lit("out/"), "id").alias("sub"))
    for fpp in (0.05, 0.01):
        blooms = t.build_blooms(g, fpp)
        own = blooms.of(("p", "sub"))
        assert bloom_filter_rows(rows.select("sub"), "sub", own).count() == n
        assert bloom_filter_rows(others, "sub", own).count() / n < 2 * fpp


def test_filters_survive_saving(social, tmp_path):
    blooms = t.build_blooms(social, fpp=0.001)
    t.save_blooms(blooms, str(tmp_path / "b"))
    loaded = t.load_blooms(social.spark, str(tmp_path / "b"))
    assert loaded.hashes == blooms.hashes
    rows = social.prop("friends")
    for side in (("lives", "sub"), ("tweet", "sub")):
        a = bloom_filter_rows(rows, "obj", blooms.of(side)).collect()
        assert sorted(a) == sorted(bloom_filter_rows(rows, "obj", loaded.of(side)).collect())


def test_partners():
    patterns = [("?x", "p", "?y"), ("?y", "p", "?z"), ("?x", "q", "?x"), ("?y", "?free", "?x"), ("c", "r", "?z")]
    assert partner_sides(patterns, 0) == {"sub": [("q", "obj"), ("q", "sub")], "obj": [("p", "sub")]}
    assert partner_sides(patterns, 1) == {"sub": [("p", "obj")], "obj": [("r", "obj")]}
    # A self-loop's own other end is a partner.
    assert partner_sides(patterns, 2) == {"sub": [("p", "sub"), ("q", "obj")], "obj": [("p", "sub"), ("q", "sub")]}
    assert partner_sides(patterns, 3) == {}


@pytest.mark.parametrize("mode,limit", [("exact", None), ("bloom", 10**9), ("bloom", 0)])
def test_both_sides_are_reduced(social, mode, limit):
    options = {} if limit is None else {"limit": limit}
    got = t.reduce_property(
        social, "friends", "both", {"sub": [("mention", "obj")], "obj": [("tweet", "sub")]}, mode, **options
    )
    kept = {tuple(r) for r in got.collect()}
    exact = {("Sam", "Ann"), ("Sam", "Bob"), ("Ann", "Bob"), ("Bob", "Bob")}
    assert exact <= kept and (mode == "bloom" or kept == exact)


def test_bloom_rows_do_not_depend_on_the_limit(spark):
    """Broadcast whole or joined by chunk, also with many chunks, the same rows pass."""
    rows = spark.range(300_000).select(F.concat(F.lit("a"), "id").alias("sub"), F.lit("p").alias("prop"), F.lit("o").alias("obj"))
    half = spark.range(0, 300_000, 2).select(F.concat(F.lit("a"), "id").alias("sub"), F.lit("q").alias("prop"), F.lit("o").alias("obj"))
    g = Graph(rows.union(half))
    got = [t.reduce_property(g, "p", "sub", [("q", "sub")], "bloom", limit=limit) for limit in (0, 10**9)]
    assert got[0].exceptAll(got[1]).isEmpty() and got[1].exceptAll(got[0]).isEmpty()
    kept = got[0].count()
    assert 150_000 <= kept <= 150_000 + 0.03 * 150_000
    assert g.blooms.words.where("prop = 'q' and side = 'sub'").count() > 1


def test_reductions_are_kept_by_canonical_signature(social):
    kept = Reductions(social)
    kept.table(CHAIN, 0)
    assert kept.is_kept(CHAIN[::-1], 1)
    assert kept.key(CHAIN, 0) == "friends_TRPO_JOIN_lives_TRPS"
    assert not kept.is_kept(CHAIN, 1)
    one = Reductions(social, side="one")
    triangle = [("?x", "friends", "?y"), ("?x", "mention", "?y")]
    assert one.key(triangle, 0) == "friends_TRPS_JOIN_mention_TRPS"
    kept.release()


def test_digits_in_property_names_are_kept(spark):
    g = Graph(spark.createDataFrame([("a", "p_12", "b"), ("b", "p_1", "c")], "sub string, prop string, obj string"))
    patterns = [("?x", "p_12", "?y"), ("?y", "p_1", "?z")]
    assert Reductions(g).key(patterns, 0) == "p_12_TRPO_JOIN_p_1_TRPS"
    assert t.bgp_count(g, patterns, reductions="exact").first()["n"] == 1


def test_materialized_reductions(social, tmp_path):
    signatures = ["friends_TRPO_JOIN_tweet_TRPS", "friends_TRPO_JOIN_likes_TRPS_JOIN_tweet_TRPS", "lives_TRPS_JOIN_none_TRPS"]
    for mode in ("exact", "bloom"):
        path = str(tmp_path / mode)
        stats = {r["signature"]: r["n"] for r in t.materialize_reductions(social, signatures, path, mode).collect()}
        assert stats == {signatures[0]: 4, signatures[1]: 3, signatures[2]: 0}
        assert {tuple(r) for r in t.reduced(social, path, "friends", signatures[1]).collect()} == {
            ("Sam", "Bob"), ("Ann", "Bob"), ("Bob", "Bob")
        }
        # Without a usable marker the whole table is read.
        assert t.reduced(social, path, "friends", "friends_TRPS_JOIN_x_TRPS").count() == 4
        assert t.reduced(social, path, "tweet", None).count() == 3
        best = t.best_reduction(social.spark.read.parquet(f"{path}/stats"))
        assert [tuple(r) for r in best.collect()] == [("friends", signatures[1], 3)]


def test_candidates(social):
    for mode in ("exact", "bloom"):
        assert {r[0] for r in t.candidate_properties(social, s="Sam", o="Bob", mode=mode).collect()} >= {"friends", "mention"}
    assert {r[0] for r in t.candidate_properties(social, s="Sam", o="Bob").collect()} == {"friends", "mention"}
    # An unknown constant leaves nothing, whatever the other side has.
    assert t.candidate_properties(social, s="Sam", o="Nobody").count() == 0
    # The side is the one the variable has in the pattern; the values' own property counts, too.
    values = social.prop("lives").select("sub")
    for mode in ("exact", "bloom"):
        found = {r[0] for r in t.candidate_properties_by_join(social, values, "obj", mode).collect()}
        assert {"friends", "mention"} <= found
        assert mode == "bloom" or found == {"friends", "mention"}
    assert "lives" in {r[0] for r in t.candidate_properties_by_join(social, values, "sub").collect()}
    verified = t.verified_properties(social, "Sam", "?o", t.properties(social))
    assert {r["prop"]: r["n"] for r in verified.collect()} == {"friends": 2, "mention": 2, "lives": 1}


def test_pruned_free_property_gives_the_same_rows(social):
    patterns = [("?x", "?p", "?y"), ("?y", "lives", "Boston"), ("Sam", "?q", "?x")]
    expected = Counter(map(tuple, t.bgp(social, patterns).select("x", "p", "y", "q").collect()))
    for mode in ("exact", "bloom"):
        got = t.bgp(social, patterns, candidates=mode).select("x", "p", "y", "q")
        assert Counter(map(tuple, got.collect())) == expected


def test_candidates_prune_folders_without_moving_triples(spark, social, tmp_path):
    from trefoil.operators.pattern import of_properties

    g = social.save(str(tmp_path / "graph"))
    wanted = sorted({r["prop"] for r in social.triples.collect()})[:2]
    candidates = spark.createDataFrame([(p,) for p in wanted * 3], "prop string")
    want = sorted(tuple(r) for r in social.triples.where(social.triples["prop"].isin(wanted)).collect())
    listed = of_properties(g, candidates)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and f"PartitionFilters: [prop#" in plan and all(p in plan for p in wanted)
    assert sorted(tuple(r) for r in listed.collect()) == want
    joined = of_properties(g, candidates, limit=1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "dynamicpruning" in plan
    assert sorted(tuple(r) for r in joined.collect()) == want
    assert of_properties(g, candidates.where("false")).count() == 0


def test_report(social):
    report = {r["prop"]: (r["n_before"], r["n_after"]) for r in t.reduction_report(social, CHAIN).collect()}
    assert report == {"friends": (4, 4), "lives": (3, 2)}


def test_runs(social):
    table = t.run_workload(social, [("a", CHAIN), ("b", CHAIN), ("c", [("?x", "lives", "Boston")])])
    rows = {r["query"]: r for r in table.collect()}
    assert (rows["a"]["is_warm"], rows["b"]["is_warm"], rows["c"]["is_warm"]) == (False, True, False)
    assert (rows["a"]["num_results"], rows["a"]["table_sizes"], rows["a"]["reduction_sizes"]) == (4, 7, 6)
    assert (rows["a"]["max_joins"], rows["a"]["num_triples"]) == (2, 2)


def test_filters_are_probed_by_chunk(spark):
    """A small filter is broadcast in chunks, and its test is no part of a generated method that grows with the filters."""
    rows = spark.range(40_000).select(F.concat(F.lit("s"), "id").alias("sub"), F.lit("p").alias("prop"), F.concat(F.lit("o"), "id").alias("obj"))
    blooms = build_blooms(Graph(rows), 0.01)
    probes = spark.range(30_000, 60_000).select(F.concat(F.lit("s"), "id").alias("sub"), F.concat(F.lit("o"), "id").alias("obj"))
    passed = bloom_filter_rows(bloom_filter_rows(probes, "sub", blooms.of(("p", "sub"))), "obj", blooms.of(("p", "obj")))
    assert 10_000 <= passed.count() <= 10_000 + 0.001 * 20_000
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan

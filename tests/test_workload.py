"""Query logs as data, against plain Python on small workloads."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import trefoil as t

SCHEMA = "query_id long, query_seq long, pos int, s string, p string, o string"
PATTERNS = {
    1: [("?x", "p", "?y"), ("?y", "q", "?z"), ("?y", "q", "?w")],
    2: [("?a", "q", "?b"), ("?c", "p", "?a")],
    3: [("?v", "p", "?v"), ("?v", "?free", "c")],
    4: [("c", "p", "?y")],
    5: [("?m", "p", "?k"), ("?k", "q", "?n"), ("?k", "q", "?o")],
}


@pytest.fixture(scope="module")
def workload(spark):
    rows = [(q, q, i, *p) for q, ps in PATTERNS.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


def ends(patterns):
    return [
        (term, i, p[1], side) for i, p in enumerate(patterns) if not p[1].startswith("?")
        for side, term in (("sub", p[0]), ("obj", p[2])) if term.startswith("?")
    ]


def tag(prop, side):
    return prop + ("_TRPS" if side == "sub" else "_TRPO")


def expected_signatures():
    found = {}
    for q, patterns in PATTERNS.items():
        all_ends = ends(patterns)
        for var, i, prop, side in all_ends:
            partners = {tag(p, s) for v, j, p, s in all_ends if v == var and (j, s) != (i, side)}
            if partners:
                found[q, i, side] = "_JOIN_".join([tag(prop, side), *sorted(partners)])
    return found


def test_join_variables(workload):
    got = Counter(map(tuple, t.join_variables(workload).collect()))
    assert got == Counter((q, v, i, p, s) for q, ps in PATTERNS.items() for v, i, p, s in ends(ps))


def test_join_pairs(workload):
    expected = Counter()
    for patterns in PATTERNS.values():
        for a, b in combinations(ends(patterns), 2):
            if a[0] == b[0]:
                expected[sum(sorted([a[2:], b[2:]]), ())] += 1
    assert {tuple(r)[:4]: r["n"] for r in t.join_pairs(workload).collect()} == expected


def test_signatures(workload):
    got = {(r["query_id"], r["pos"], r["side"]): r["sig"] for r in t.reduction_signatures(workload).collect()}
    assert got == expected_signatures()


def test_candidates_hold_every_signature(workload):
    stored = {r["signature"] for r in t.candidate_signatures(workload).collect()}
    assert set(expected_signatures().values()) <= stored
    assert "q_TRPS_JOIN_q_TRPS" in stored and "p_TRPO_JOIN_q_TRPS" in stored


def test_warm_cold(workload):
    first, expected = {}, {}
    for (q, _, _), sig in sorted(expected_signatures().items()):
        expected[q, sig] = first.setdefault(sig, q) < q
    got = {(r["query_id"], r["sig"]): r["is_warm"] for r in t.warm_cold(workload).collect()}
    assert got == expected and any(got.values())


def test_features(workload):
    expected = {
        q: (len(ps), max(Counter(e[0] for e in ends(ps)).values(), default=0)) for q, ps in PATTERNS.items()
    }
    got = {r["query_id"]: (r["num_triples"], r["max_joins"]) for r in t.query_features(workload).collect()}
    assert got == expected


def test_extraction(spark):
    texts = [
        "PREFIX g: <http://x.org/> PREFIX h: <http://y.org/> SELECT ?a WHERE {\n ?a g:p <http://x.org/c> .\n ?a h:q \"a b\"@en ;}",
        "BASE <http://x.org/>\nselect distinct * where { ?a <p> ?b . ?a ?q \"1.5\"^^<http://t> FILTER (?a != ?b) }",
        "PREFIX : <http://x.org/> SELECT ?s WHERE { ?s :p u:v . <http://z.org/k> <rel> ?s .}",
        "SELECT ?s ?o WHERE {?s <http://x.org/p> ?o .}",
    ]
    log = spark.createDataFrame([(i, i, q) for i, q in enumerate(texts)], "query_id long, query_seq long, query string")
    got = {(r["query_id"], r["pos"]): (r["s"], r["p"], r["o"]) for r in t.extract_patterns(log, [("g", "http://x.org/")]).collect()}
    assert got == {
        (0, 0): ("?a", "g__p", "g__c"), (1, 0): ("?a", "g__p", "?b"), (1, 1): ("?a", "?q", '"1.5"^^<http://t>'),
        (2, 0): ("?s", "g__p", "u:v"), (2, 1): ("http://z.org/k", "rel", "?s"), (3, 0): ("?s", "g__p", "?o"),
    } | ({(0, 1): got[0, 1]} if (0, 1) in got else {})
    lists = dict(t.pattern_lists(t.extract_patterns(log, [("g", "http://x.org/")])))
    assert lists[2] == [("?s", "g__p", "u:v"), ("http://z.org/k", "rel", "?s")]


def test_extracted_log_runs_on_its_graph(spark, social):
    log = spark.createDataFrame(
        [(1, 1, "SELECT ?x WHERE { <Sam> <friends> ?x . ?x <lives> <Atlanta> .}"), (2, 2, "SELECT * WHERE { ?x <friends> ?x }")],
        "query_id long, query_seq long, query string",
    )
    table = t.run_workload(social, t.pattern_lists(t.extract_patterns(log)))
    assert {r["query"]: r["num_results"] for r in table.collect()} == {"1": 1, "2": 1}


def test_samples(spark):
    queries = spark.range(1, 1001).select(F.col("id").alias("query_id"), (-F.col("id")).alias("query_seq"))
    got = t.workload_sample(queries, 3, min_class=2, exclude=[4])
    by_class = {}
    for r in got.collect():
        by_class.setdefault(r["query_class"], []).append(r["query_id"])
    assert sorted(by_class) == [2, 3, 5, 6, 7, 8, 9, 10]
    assert sorted(by_class[2]) == [198, 199, 200]
    triples = spark.range(500).select(
        F.col("id").cast("string").alias("sub"), F.lit("p").alias("prop"),
        F.when(F.col("id") % 10 == 0, F.lit('"x"@en')).otherwise(F.lit('"x"')).alias("obj"),
    )
    sample = t.sample_slices(triples, 100, 30, seed=3).collect()
    assert len({r["sub"] for r in sample}) == len(sample) <= 100
    assert all(r["obj"] == '"x"' for r in sample)
    sizes = Counter(r["slice"] for r in sample)
    assert all(sizes[i] == 30 for i in range(max(sizes)))


def test_sample_does_not_depend_on_the_layout(spark):
    triples = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sub"),
        F.concat(F.lit("p"), F.col("id") % 3).alias("prop"), F.lit("o").alias("obj"),
    )
    one, many = [
        sorted(map(tuple, t.sample_slices(triples.repartition(k), 300, 100, seed=5).collect())) for k in (1, 64)
    ]
    assert one == many and len(one) == 300
    other = sorted(map(tuple, t.sample_slices(triples, 300, 100, seed=6).collect()))
    assert other != one
    counted = {r["prop"]: r["n"] for r in t.sample_properties(t.sample_slices(triples, 300, 100, seed=5)).collect()}
    assert counted == Counter(r[1] for r in one)


def test_sample_draws_rows_not_values(spark):
    # Copies make up a third of the rows and about that of the sample.
    triples = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sub"),
        F.lit("p").alias("prop"), F.lit("o").alias("obj"),
    )
    hot = t.sample_slices(triples, 600, 600).where("sub = 'hot'").count()
    assert 130 < hot < 270


def test_mining(spark):
    rows = []
    for q in range(60):
        for i, p in enumerate(["a", "b", "c"] if q % 2 else ["a", "d"]):
            rows.append((q, q, i, "?x", p, f"?{i}"))
    rows.append((99, 99, 0, "?x", "a", "?y"))
    workload = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r["items"]): r["freq"] for r in t.frequent_patterns(workload, 0.08).collect()}
    assert got == {("a", "b"): 30, ("a", "c"): 30, ("b", "c"): 30, ("a", "b", "c"): 30, ("a", "d"): 30}
    near = t.similar_properties(workload, "b", k=2, min_count=5).collect()
    assert len(near) == 2 and "b" not in {r["word"] for r in near}


def test_comparison(spark):
    runs = spark.createDataFrame(
        [(1, 10.0, 2, 1, True), (2, 20.0, 2, 2, False), (101, 30.0, 3, 1, True)],
        "query_id long, time_ms double, num_triples int, max_joins int, is_warm boolean",
    )
    other = spark.createDataFrame([(1, 1.0), (2, 3.0), (101, 5.0), (7, 100.0)], "query_id long, time_ms double")
    assert {tuple(r) for r in t.mean_time_by_class(runs).collect()} == {(1, 15.0), (2, 30.0)}
    assert {tuple(r) for r in t.mean_time_by_size(runs, other).collect()} == {(2, 15.0, 2.0), (3, 30.0, 5.0)}
    assert {tuple(r) for r in t.mean_time_by_joins(runs, other).collect()} == {(1, 20.0, 3.0)}
    assert [tuple(r) for r in t.cold_queries(runs, other).collect()] == [(2, 20.0, 3.0)]
    ranked = t.rank_aligned(runs, other).orderBy("rank").collect()
    # The longer list keeps its last rank, without a partner.
    assert [tuple(r) for r in ranked] == [(1, 30.0, 100.0), (2, 20.0, 5.0), (3, 10.0, 3.0), (4, None, 1.0)]

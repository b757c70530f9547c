"""Query texts: read whole, or listed with a reason."""

import pytest
from pyspark.sql import functions as F

import trefoil as t

RDF = [("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("g", "http://g/")]
LONG = '"' + 'y\\"' * 60_000 + '"'
READ = {
    'SELECT * WHERE { ?x <p> "a \\"b\\" c" . ?x <q> ?y }': (["?x", "?y"], False, [], [("?x", "p", '"a \\"b\\" c"'), ("?x", "q", "?y")]),
    "SELECT ?x { ?x <p> ?y ; <q> ?z , ?w ; a <C> ; . }": (
        ["?x"], False, [], [("?x", "p", "?y"), ("?x", "q", "?z"), ("?x", "q", "?w"), ("?x", "rdf__type", "C")]),
    'PREFIX h: <http://g/> PREFIX x: <http://x/> select distinct ?a $b where{?a h:p ?b FILTER(?a!=?b && ?b != h:y)?b x:q.r "5"^^h:int}': (
        ["?a", "?b"], True, [("?a", "!=", "?b"), ("?b", "!=", "g__y")], [("?a", "g__p", "?b"), ("?b", "http://x/q.r", '"5"^^<http://g/int>')]),
    "BASE <http://g/>\nSELECT ?n\nWHERE {\n ?a <name> ?n .\n ?b <name> ?n\n FILTER (?a != ?b)\n}\n": (
        ["?n"], False, [("?a", "!=", "?b")], [("?a", "g__name", "?n"), ("?b", "g__name", "?n")]),
    "# { all\nSELECT ?x WHERE { ?x <p> 'it \"s' . # no } here .\n ?x <q#r> ?z . }": (["?x"], False, [], [("?x", "p", '"it \\"s"'), ("?x", "q#r", "?z")]),
    f"SELECT ?x WHERE {{ ?x <p> {LONG}@en-GB }}": (["?x"], False, [], [("?x", "p", LONG + "@en-GB")]),
    'SELECT ?x WHERE { ?x <p> "one . two ; { three , FILTER ( a != b )" }': (["?x"], False, [], [("?x", "p", '"one . two ; { three , FILTER ( a != b )"')]),
    "PREFIX d: <http://x/> PREFIX d: <http://g/> SELECT ?x WHERE { d:a d:p ?x . }": (["?x"], False, [], [("g__a", "g__p", "?x")]),
    "PREFIX : <http://g/> SELECT ?p WHERE { :a ?p :Bob.Smith . . }": (["?p"], False, [], [("g__a", "?p", "g__Bob.Smith")]),
    "SELECT ?x WHERE { ?x sorg__likes Bob's . other:n <p>\u0001 ?x }": (["?x"], False, [], [("?x", "sorg__likes", "Bob's"), ("other:n", "p", "?x")]),
    "SELECT ?a WHERE { ?a <p> a . a a a }": (["?a"], False, [], [("?a", "p", "a"), ("a", "rdf__type", "a")]),
}
REJECTED = {
    None: "no plain SELECT", "": "no plain SELECT", "ASK { ?x <p> ?y }": "no plain SELECT", "SELECT ?x FROM <g> { ?x <p> ?y }": "no plain SELECT",
    "SELECT (COUNT(?x) AS ?n) { ?x <p> ?y }": "no plain SELECT", "SELECT ?x WHERE ?x <p> ?y": "no plain SELECT",
    "SELECT ?x WHERE { ?x <p> ?y": "no group", "SELECT ?x WHERE { ?x <p> ?y } LIMIT 3": "words after the group",
    "SELECT ?x { ?x <p> ?y OPTIONAL { ?y <q> ?z } }": "nested group", "SELECT ?x { { ?x <p> ?y } UNION { ?x <q> ?y } }": "nested group",
    'SELECT ?x WHERE { ?x <p> "open .}': "unreadable characters", "SELECT ?x WHERE { ?x <p> }": "unreadable pattern",
    "SELECT ?x WHERE { ?x <p> ?y ?z }": "unreadable pattern", "SELECT ?x WHERE { ?x <p> ?y ; ?z }": "unreadable pattern",
    "SELECT ?x WHERE { ?x <p> ?y , }": "unreadable pattern", "SELECT ?x WHERE { ?x <p> _:b }": "unreadable pattern",
    "SELECT ?x WHERE { ?x <p> [ <q> ?y ] }": "unreadable pattern", "SELECT ?x WHERE { ?x <p> ?y FILTER regex(?y, \"a\") }": "other filter",
    "SELECT ?x WHERE { ?x <p> ?y FILTER (?y = ?x) }": "other filter", "SELECT ?x WHERE { ?x <p> ?y FILTER (<a> != <b>) }": "other filter",
    "SELECT ?x WHERE { ?x <p> ?y FILTER (?x != ?y || ?y != <a>) }": "other filter", "SELECT ?q WHERE { ?x <p> ?y }": "variable without pattern",
    "SELECT ?x WHERE { ?x <p> ?y FILTER (?x != ?q) }": "variable without pattern", "SELECT ?x WHERE { }": "no pattern",
}


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, i, q) for i, q in enumerate([*READ, *REJECTED])]
    return spark.createDataFrame(rows, "query_id long, query_seq long, query string")


def test_read_whole(log):
    found = {int(q.name): (q.select, q.distinct, q.filters, q.patterns) for q in t.logged_queries(log, RDF)}
    assert found == dict(enumerate(READ.values()))


def test_rows(log):
    rows = t.extract_patterns(log, RDF).orderBy("query_id", "pos").collect()
    want = [(i, i, k, *p) for i, q in enumerate(READ.values()) for k, p in enumerate(q[3])]
    assert [tuple(r) for r in rows] == want


def test_rejected(log):
    found = {r["query_id"]: r["reason"] for r in t.rejected_queries(log).collect()}
    assert found == {len(READ) + i: reason for i, reason in enumerate(REJECTED.values())}


def test_steps_are_not_repeated(log):
    """Each search over a text stands once in the plan, whatever is filtered above it."""
    plan = t.extract_patterns(log, RDF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 9 and plan.count("flatten") <= 4


def test_run_as_asked(spark, social):
    texts = ["SELECT * WHERE { ?x friends ?y }", "SELECT ?x WHERE { ?x friends ?y FILTER (?x != ?y) }", "SELECT DISTINCT ?x { ?x friends ?y ; lives ?z }",
             "SELECT DISTINCT ?z { ?x lives ?z . ?y lives ?z FILTER (?x != ?y) }", "SELECT ?x { ?x friends ?y } LIMIT 1"]
    log = spark.createDataFrame([(i, i, q) for i, q in enumerate(texts)], "query_id long, query_seq long, query string")
    runs = t.run_workload(social, t.logged_queries(log)).collect()
    assert [(r["query"], r["num_results"]) for r in runs] == [("0", 4), ("1", 3), ("2", 3), ("3", 1)]


def test_empty_log(spark):
    log = spark.createDataFrame([], "query_id long, query_seq long, query string")
    assert t.extract_patterns(log).count() == t.rejected_queries(log).count() == t.query_heads(log).count() == 0
    assert list(t.logged_queries(log)) == []

"""Without statistics, variables are summed away before others are opened."""

import re
from collections import Counter
from itertools import product

import pytest

from trefoil import Graph, bgp, bgp_grouped

SEGMENTS = "VWXYZ"
PATTERNS = [("?a", "to", "?x"), ("?b", "to", "?x"), ("?a", "in", "?s"), ("?b", "in", "?t")]


@pytest.fixture(scope="module")
def triples():
    # Groups of 1, 40 and 60 members; a member in two segments, one in none, and a triple that comes twice.
    members = [(f"m{i}", "x0" if i < 1 else "x1" if i < 41 else "x2", SEGMENTS[i % 5]) for i in range(101)]
    rows = [(m, "to", x) for m, x, _ in members] + [(m, "in", s) for m, _, s in members[:-1]]
    return rows + [("m3", "in", "V"), ("m5", "to", "x1")]


def answers(triples):
    to, within = [(s, o) for s, p, o in triples if p == "to"], [(s, o) for s, p, o in triples if p == "in"]
    found = Counter()
    for (a, x), (b, y) in product(to, to):
        if x == y and a != b:
            found.update((s, t) for (c, s), (d, t) in product([r for r in within if r[0] == a], [r for r in within if r[0] == b]))
    return found


def test_answers(spark, triples):
    g = Graph(spark.createDataFrame(triples, "sub string, prop string, obj string"))
    expected, filters = answers(triples), [("?a", "!=", "?b")]
    assert {(r["s"], r["t"]): r["n"] for r in bgp_grouped(g, PATTERNS, ["?s", "?t"], filters).collect()} == expected
    assert Counter(map(tuple, bgp(g, PATTERNS, ["?s", "?t"], True, filters).collect())) == Counter(expected.keys())


def test_pairs_are_not_listed(spark, triples):
    g = Graph(spark.createDataFrame(triples, "sub string, prop string, obj string"))
    plan = bgp(g, PATTERNS, ["?s", "?t"], True, [("?a", "!=", "?b")])._jdf.queryExecution().executedPlan().toString()
    keys = [set(re.findall(r"(\w+)#", k)) for k in re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan)]
    assert {"x", "s"} in keys and {"a", "b"} not in keys

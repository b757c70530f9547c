"""Patterns: every case against brute force on a small graph."""

import itertools
import random
from collections import Counter

import pytest

from trefoil import Graph, bgp, bgp_count, bgp_grouped, join_order, pattern
from social import SOCIAL

QUERIES = {
    "star": [("?x", "friends", "?y"), ("?x", "lives", "?z")],
    "chain": [("?x", "friends", "?y"), ("?y", "lives", "?z")],
    "object_object": [("?x", "lives", "?z"), ("?y", "lives", "?z")],
    "two_variables": [("?x", "mention", "?y"), ("?x", "friends", "?y")],
    "cycle": [("?x", "friends", "?y"), ("?x", "lives", "?z"), ("?y", "lives", "?z")],
    "self_loop": [("?x", "friends", "?x")],
    "self_loop_first": [("?x", "friends", "?x"), ("?x", "lives", "?z")],
    "self_loop_last": [("?y", "mention", "?x"), ("?x", "friends", "?x")],
    "repeated_property": [("?x", "friends", "?y"), ("?y", "friends", "?z"), ("?z", "friends", "?w")],
    "third_connects": [("?x", "friends", "?y"), ("?z", "tweet", "?t"), ("?y", "mention", "?z")],
    "constants": [("Sam", "friends", "?x"), ("?x", "lives", "Atlanta")],
    "duplicates": [("?x", "tweet", "?t"), ("?y", "likes", "?t")],
    "tagged_literal": [("?x", "tweet", '"t2"@en'), ("?x", "lives", "?z")],
    "constant_only": [("Ann", "tweet", '"t1"'), ("?x", "lives", "Boston")],
    "constant_only_missing": [("Ann", "tweet", '"t9"'), ("?x", "lives", "Boston")],
    "free_property": [("Sam", "?p", "?x")],
    "free_property_join": [("?x", "?p", "?y"), ("?y", "tweet", "?t")],
    "free_all": [("?s", "?p", "?o")],
    "free_twice": [("Sam", "?p", "?x"), ("?y", "?q", "?x")],
    "same_property": [("Sam", "?p", "?x"), ("Ann", "?p", "?y")],
    "empty": [("?x", "nothing", "?y"), ("?y", "lives", "?z")],
}


def rows(df, names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def names_of(patterns):
    return list(dict.fromkeys(t[1:] for p in patterns for t in p if t.startswith("?")))


@pytest.mark.parametrize("name", QUERIES)
def test_rows_counts_and_groups(social, solve, name):
    patterns = QUERIES[name]
    names = names_of(patterns)
    cross = name.startswith("constant_only")
    expected = Counter(tuple(a[f"?{n}"] for n in names) for a in solve(SOCIAL, patterns))
    assert rows(bgp(social, patterns), names) == expected
    assert bgp_count(social, patterns).first()["n"] == sum(expected.values())
    first = Counter()
    for key, n in expected.items():
        first[key[:1]] += n
    grouped = bgp_grouped(social, patterns, [f"?{names[0]}"])
    assert {(r[names[0]],): r["n"] for r in grouped.collect()} == first
    distinct = rows(bgp(social, patterns, select=[f"?{names[-1]}"], distinct=True, allow_cross=cross), names[-1:])
    assert distinct == Counter({key[-1:]: 1 for key in expected})


@pytest.mark.parametrize("name", ["star", "cycle", "repeated_property", "third_connects", "free_property_join"])
def test_pattern_order_does_not_matter(social, name):
    patterns = QUERIES[name]
    names = names_of(patterns)
    expected = rows(bgp(social, patterns), names)
    for reordered in itertools.permutations(patterns):
        assert rows(bgp(social, list(reordered)), names) == expected


@pytest.mark.parametrize("mode", ["exact", "bloom"])
@pytest.mark.parametrize("name", ["star", "chain", "cycle", "self_loop_last", "repeated_property", "empty"])
def test_reductions_do_not_change_answers(social, mode, name):
    patterns = QUERIES[name]
    names = names_of(patterns)
    assert rows(bgp(social, patterns, reductions=mode), names) == rows(bgp(social, patterns), names)


@pytest.mark.parametrize("filters", [
    [("?x", "!=", "?y")], [("?x", "!=", "?y"), ("?y", "!=", "?w")], [("?z", "!=", "Atlanta")],
    [("?x", "!=", "?y"), ("?x", "!=", "?w"), ("?y", "!=", "?w")],
])
def test_filters(social, solve, filters):
    patterns = [("?x", "lives", "?z"), ("?y", "lives", "?z"), ("?w", "lives", "?z")]
    names = names_of(patterns)
    answers = solve(SOCIAL, patterns, filters)
    assert rows(bgp(social, patterns, filters=filters), names) == Counter(tuple(a[f"?{n}"] for n in names) for a in answers)
    assert bgp_count(social, patterns, filters).first()["n"] == len(answers)
    for by in (["?z"], ["?x"], ["?y", "?x"], ["?w", "?z"]):
        grouped = bgp_grouped(social, patterns, by, filters)
        assert rows(grouped, [b[1:] for b in by] + ["n"]) == Counter({
            key + (n,): 1 for key, n in Counter(tuple(a[b] for b in by) for a in answers).items()
        })


def test_filter_inside_one_pattern(social, solve):
    patterns, filters = [("?x", "friends", "?y")], [("?x", "!=", "?y")]
    assert bgp_count(social, patterns, filters).first()["n"] == len(solve(SOCIAL, patterns, filters)) == 3


def test_random_queries(spark, solve):
    """Random graphs and patterns, with hot values and copies of triples."""
    draw = random.Random(7)
    nodes = ["hot", "a", "b", "c"]
    triples = [
        (draw.choice(nodes[:2] * 2 + nodes), draw.choice("pq"), draw.choice(nodes[:1] * 3 + nodes)) for _ in range(24)
    ]
    g = Graph(spark.createDataFrame(triples, "sub string, prop string, obj string"))
    terms = ["?x", "?y", "?z", "?w", "hot"]
    for _ in range(12):
        patterns = [
            (draw.choice(terms), draw.choice(["p", "q", "p", "q", "?r"]), draw.choice(terms)) for _ in range(draw.randint(1, 4))
        ]
        names = names_of(patterns)
        filters = [("?x", "!=", "?y")] if {"x", "y"} <= set(names) else []
        answers = solve(triples, patterns, filters)
        options = {"allow_cross": True, "filters": filters}
        got = rows(bgp(g, patterns, **options), names)
        assert got == Counter(tuple(a[f"?{n}"] for n in names) for a in answers), patterns
        assert bgp_count(g, patterns, **options).first()["n"] == len(answers), patterns


def test_cross_product_is_explicit(social):
    patterns = [("?x", "likes", "?t"), ("?y", "lives", "Atlanta")]
    for ask in (bgp, bgp_count):
        with pytest.raises(ValueError):
            ask(social, patterns)
    assert bgp(social, patterns, allow_cross=True).count() == 2
    assert bgp_count(social, patterns, allow_cross=True).first()["n"] == 2
    grouped = bgp_grouped(social, patterns, ["?x", "?y"], allow_cross=True)
    assert rows(grouped, ["x", "y", "n"]) == Counter([("Bob", "Sam", 1), ("Bob", "Ann", 1)])


def test_count_of_constant_patterns(social):
    assert bgp_count(social, [("Ann", "tweet", '"t1"')]).first()["n"] == 2
    assert bgp_count(social, [("Ann", "tweet", '"t1"'), ("Bob", "likes", '"t1"')]).first()["n"] == 2
    assert bgp_count(social, [("Ann", "tweet", '"t9"')]).first()["n"] == 0
    assert bgp(social, [("Ann", "tweet", '"t1"')]).count() == 2


def test_select_keeps_the_bag(social):
    assert rows(bgp(social, [("?x", "tweet", "?t")], select=["?x"]), ["x"]) == Counter({("Ann",): 2, ("Bob",): 1})


def test_count_name_may_not_be_a_grouped_variable(social):
    with pytest.raises(ValueError):
        bgp_grouped(social, [("?n", "lives", "?z")], ["?n"])
    named = bgp_grouped(social, [("?n", "lives", "?z")], ["?n"], count_as="number")
    assert set(named.columns) == {"n", "number"}


def test_repeated_variable_at_property(spark):
    g = Graph(spark.createDataFrame([("p", "p", "p"), ("p", "p", "q"), ("q", "p", "q")], "sub string, prop string, obj string"))
    assert pattern(g, "?x", "?x", "?x").count() == 1
    assert pattern(g, "?x", "?x", "?y").count() == 2
    assert pattern(g, "?x", "?p", "?x").count() == 2


def test_join_order():
    patterns = [("?a", "big", "?b"), ("?b", "small", "?c"), ("?c", "mid", "?d"), ("?d", "big", "Const")]
    counts = {"big": 100, "mid": 10, "small": 1}
    assert join_order(patterns, counts) == [3, 2, 1, 0]
    assert join_order(patterns[:2], counts) == [0, 1]
    # Same property twice, and a part that joins nothing: every pattern stays, once.
    odd = [("?a", "p", "?b"), ("?x", "p", "?y"), ("?b", "p", "?c")]
    assert join_order(odd, {"p": 5}) == [0, 2, 1]


def test_stored_statistics_order_joins(social, tmp_path):
    stored = social.save(str(tmp_path / "g"), fpp=0.01)
    assert stored.counts(["lives", "tweet", "none"]) == {"lives": 3, "tweet": 3, "none": 0}
    patterns = QUERIES["third_connects"]
    assert rows(bgp(stored, patterns), names_of(patterns)) == rows(bgp(social, patterns), names_of(patterns))

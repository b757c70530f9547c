import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trefoil.llm.neighbours import Tree, nearest


def exact(rows, queries, k):
    def sound(v):
        return v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    best = {}
    for q, a in queries:
        if q is None or not sound(a):
            continue
        for i, b in rows:
            if i is None or not sound(b) or i == q:
                continue
            a64, b64 = np.array(a, float), np.array(b, float)
            s = float((a64 * b64).sum() / (np.sqrt((a64 * a64).sum()) * np.sqrt((b64 * b64).sum())))
            best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, -9))
    return {q: sorted(c.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k] for q, c in best.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(600)]
    hot = data[7][1]
    data += [(1000 + i, hot) for i in range(300)]
    return data + [
        (700, None), (701, []), (702, [0.0] * 8), (703, [float("nan")] * 8), (704, [1.0] * 7 + [None]), (705, [float("inf")] * 8),
        (706, [1.0] * 3), (None, [1.0] * 8), (0, data[0][1]), (1, data[2][1]),
    ]


def test_exact_with_factor_one(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, shard string, score int")
    queries = df.where(F.col("vec_id") % 50 == 0)
    asked = [(i, v) for i, v in rows if i is not None and i % 50 == 0]
    want = exact(rows, asked, 5)
    for options in ({}, {"shard": 200, "block": 7}):
        got = {}
        for r in nearest(df, queries, factor=1.0, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def by_length(rows, queries, k):
    """``exact`` for vectors of any length, each length by itself, the best vector of an id counting."""
    best = {}
    for q, a in queries:
        for i, b in rows:
            if i != q and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                s = float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
                best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, -9))
    return {q: [i for i, _ in sorted(c.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]] for q, c in best.items()}


def found_ids(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_lengths_by_themselves(spark):
    """A stray longer vector takes nothing from the others; several lengths are searched each by itself."""
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    for extra in ([(90, [1.0] * 9)], [(100 + i, [float(x) for x in rng.standard_normal(9)]) for i in range(20)] + [(7, [1.0] * 9)]):
        df = spark.createDataFrame(data + extra, schema)
        for options in ({}, {"shard": 16, "block": 7}):
            assert found_ids(nearest(df, df, factor=1.0, **options)) == by_length(data + extra, data + extra, 5)


def test_ids_with_many_vectors(spark):
    """Vectors of the query's own id, or many of one candidate id, leave room for ``k`` distinct other ids."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(8)
    near = lambda scale: [float(x) for x in centre + scale * rng.standard_normal(8)]
    data = [(0, near(0.01)) for _ in range(40)] + [(1, near(0.02)) for _ in range(300)] + [(2 + i // 9, near(0.5)) for i in range(90)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for options in ({}, {"shard": 50, "block": 7}):
        got = found_ids(nearest(df, df.where("vec_id < 3"), factor=1.0, **options))
        assert got == by_length(data, [r for r in data if r[0] < 3], 5)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    got = nearest(few, few).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(a, b) for a in range(3) for b in range(3) if a != b]
    none = spark.createDataFrame([], schema)
    assert nearest(none, none).count() == 0


def test_factor_prunes():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    v = centres[rng.integers(0, 20, 4000)] + 0.2 * rng.standard_normal((4000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    tree, queries = Tree(v), v[:50]
    order = np.argsort(-(queries @ v.T), axis=1, kind="stable")[:, :6]
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        found, _ = tree.search(queries, 6, factor)
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, order)]) >= least

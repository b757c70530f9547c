"""Hard negatives against brute force, and the scan's bitmap."""

import math
from collections import Counter

import numpy as np
import pytest

from trefoil.llm import negatives
from trefoil.llm.negatives import hard_negatives, scan

SCHEMA = "vec_id long, embedding array<float>, label int, {}"
CLASHING = "id string, x string, asks int, dim int, bucket int, sub int, rank string, positives string"


def plain(rows, anchor):
    sound = [
        (i, [math.floor(256 * float(x)) for x in e], l) for i, e, l in rows
        if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = Counter()
    for k, (i, e, l) in enumerate(sound):
        if not anchor(i):
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(e, f)), j, m) for q, (j, f, m) in enumerate(sound) if q != k and len(f) == len(e)),
            key=lambda t: (t[0], t[1] is not None, t[1] or 0))
        for p, j, _ in [t for t in scored if t[2] == l][:5]:
            inside = [t for t in scored if t[2] != l and -30 * p <= -100 * t[0] <= -90 * p]
            for rank, (s, n, _) in enumerate(inside[:10], 1):
                out[i, j, rank, n, -p, -s] += 1
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(*r, *["c", "c", 1, 1, 1, 1, "c", "c"]) for r in rows], SCHEMA.format(CLASHING))
    found = hard_negatives(df, df["vec_id"] % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in found.collect()) == plain(rows, lambda i: i is not None and i % 10 == 0)


def vectors(n, size, seed, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, size))
    rows = []
    for i in range(n):
        label = int(draw.integers(labels))
        v = centres[label] * 0.3 + draw.normal(size=size) * 0.4
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


@pytest.mark.parametrize("block", [4096, 40])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 8 if block == 40 else 2048)
    monkeypatch.setattr(negatives, "TASK_BLOCKS", 2)
    compare(spark, vectors(400, 12, 1))


def test_hostile_rows(spark):
    rows = vectors(60, 5, 2)
    hot = rows[10][1]
    rows += [(1000 + i, hot, i % 2) for i in range(40)]
    rows += [(20, rows[20][1], rows[20][2]), (20, rows[21][1], 1)]
    rows += [(30, None, 1), (40, rows[3][1], None), (50, [1.0, None, 0.0, 0.0, 0.0], 1), (60, [float("nan")] * 5, 1), (70, [float("inf")] * 5, 1)]
    rows += [(80 + i, [0.1 * i, 0.5, 0.2], i % 2) for i in range(12)] + [(200, [], 0), (201, [], 1), (202, [], 0), (300, [0.0] * 5, 2)]
    compare(spark, rows)


def test_no_rows(spark):
    compare(spark, [])
    compare(spark, [(1, [1.0], 1), (3, [2.0], 2)])


def test_scores_too_large_fail(spark):
    with pytest.raises(Exception, match="53 bits"):
        compare(spark, [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)])


def test_scan_reads_few_dimensions():
    """Far vectors leave the bitmap before all dimensions are read, and no near one does."""
    draw = np.random.default_rng(0)
    columns = draw.integers(-20, 20, (64, 2000)).astype(float)
    a = np.sort(np.abs(draw.normal(size=64)))[::-1].round(2) ** 3 * 100
    exact = a @ columns
    bound = np.sort(exact)[-10]
    seen = []

    def prune(partial, least, greatest):
        seen.append(len(partial))
        return partial + greatest >= bound

    places, score = scan(a, columns, columns.min(axis=1), columns.max(axis=1), np.arange(2000), prune)
    assert set(np.flatnonzero(exact >= bound)) == set(places)
    assert np.allclose(score, exact[places])
    assert seen[0] == 2000 and seen[3] < 1000 and seen[-1] < 50

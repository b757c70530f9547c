"""The string kernel, the machine's held-out accuracy, and hostile rows."""

import random
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hostile import texts
from pyspark.sql import functions as F

from trefoil.llm import toxicity as t

INSULTS = ["grobel", "naxtor", "plimfus", "quonk", "vastrid"]


def plain_kernel(a, b):
    """Sum over common triples, by trying all places."""
    def features(w):
        out = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < t.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + t.DECAY ** (k - i - 2)
        return out

    def norm(w):
        return sum(t.DECAY ** (2 * (k - i - 2)) for i, _, k in combinations(range(len(w)), 3) if k - i < t.SPAN) ** 0.5

    if min(len(a), len(b)) < 3:
        return 0.0
    f, g = features(a), features(b)
    return (sum(v * g.get(x, 0) for x, v in f.items()) / norm(a) / norm(b)) ** t.POWER


def test_kernel():
    marks = ["idea", "plimfus", "naxtor", "aaa", "日本語文"]
    some = ["", "x", "ab", "idea", "idxea", "i日dea", "aaaaaa", "plmfus", "日本の語文", "plimfusnaxtor", "𐀀𐀁𐀂𐀃"]
    want = [[plain_kernel(a, b) for b in marks] for a in some]
    assert np.allclose(t.Kernel(marks)(some), want, atol=1e-5)


def test_words():
    (one,) = t.sentences("You m o r o n and i.d.i.o.t")
    assert "moron" in one and t.words("i.d.i.o.t") == ["idiot"]
    assert "".join(t.words("x" * 30)[0]) == "x" * t.WINDOW
    assert t.sentences(None) == t.sentences(" \n\n") == []


def corpus(n, seed):
    draw = random.Random(seed)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows = []
    for i in range(n):
        sentences = [[word() for _ in range(draw.randint(4, 12))] for _ in range(draw.randint(2, 9))]
        toxic = draw.random() < 0.2
        if toxic:
            for _ in range(draw.randint(1, 3)):
                s = draw.choice(sentences)
                s.insert(draw.randrange(len(s)), draw.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(800, 1)
    return t.fit([r[1] for r in rows], [r[2] == 1 for r in rows])


def test_held_out(model):
    rows = corpus(400, 2)
    score, toxic = model.scores([r[1] for r in rows]), np.array([r[2] == 1 for r in rows])
    assert (score[toxic] >= 0.3).mean() > 0.95 and (score[~toxic] >= 0.3).mean() < 0.03


@pytest.mark.parametrize("change", [" ".join, ".".join, "*".join, str.upper, lambda w: w[:2] + "-" + w[2:], lambda w: w[:3] + "k" + w[3:]])
def test_changed_insults(model, change):
    clean = [r[1] for r in corpus(200, 3) if not r[2]]
    changed = [f"{c[:40]} {change(INSULTS[i % 5])} {c[40:]}" for i, c in enumerate(clean)]
    assert (model.scores(changed) > model.scores(clean)).mean() > 0.9
    assert (model.scores(changed) >= 0.3).mean() > 0.8


def test_memory_of_words_does_not_matter(model):
    some = [r[1] for r in corpus(50, 4)]
    assert np.allclose(model.scores(some), np.concatenate([model.scores([x], limit=10) for x in some]))


def test_hostile_rows(spark, model, docs):
    got = t.toxicity(docs, model).collect()
    rows = docs.select("doc_id", "text").collect()
    score = {x: model.scores([x])[0] for x in {r["text"] for r in rows}}
    assert sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in got) == sorted((r["doc_id"] or -1, round(score[r["text"]], 9)) for r in rows)
    assert all(0 < r["score"] < 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_labels(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(None, "x"), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 1), (9999, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    found, toxic = t.training_rows(docs, labels, F.col("doc_id") % 2 == 1)
    assert len(found) == 151 and toxic.count(True) == sum(y for i, _, y in rows if i % 2) + (2 - 2 * rows[3][2])
    few, kinds = t.training_rows(docs, labels, F.lit(True), rows=60)
    assert 30 < len(few) < 100 and kinds.count(True) > 15
    assert t.training_rows(docs, labels, F.lit(True), chars=0)[0] == []


@pytest.mark.parametrize("rows", [[], [("a b", False)], [("bad", True)], [("", True), ("", False)], [(" x", True), ("y", False)]])
def test_too_few_labels(rows):
    score = t.fit([x for x, _ in rows], [y for _, y in rows]).scores([None, "", "bad", "some words"])
    assert ((score > 0) & (score < 1)).all()


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_rows_of_the_table(spark):
    from trefoil.llm.queries import QUERIES

    found = QUERIES["op13_string_kernel_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    hits = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(hits) / len(hits) > 0.75 and sum(false) / len(false) < 0.03

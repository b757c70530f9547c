"""The Merkle manifest against a plain tree, on hostile rows and every tree shape."""

import hashlib
from collections import Counter

import pytest
from hostile import texts
from pyspark.sql import functions as F

from trefoil.llm.merkle import manifest, proof_text, ranked, roll_up

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and, for each node, the digests before and after it, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, place in enumerate(at):
            run = runs[place // 16]
            ways[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        nodes, at = [sha("".join(r)) for r in runs], [p // 16 for p in at]
    return (nodes[0] if nodes else None), ways


def plain(rows, changed):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in order:
        members[s] = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in members[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        for r, way in zip(members[s], trees[s][1]):
            way = way + top
            node = leaf(changed(r))
            for b, a in way:
                node = sha(b + node + a)
            out[r[0], leaf(r), trees[s][0], root, sha("".join(b + a for b, a in way)), node, node == root] += 1
    return out


def lowered(row):
    text = row[4]
    if row[0] is None or row[0] % 5 or text is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def got(df):
    tampered = F.col("doc_id") % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest(df, FIELDS, "source", "doc_id", tampered, {"text": low})
    found = found.withColumn("proof", F.sha2(proof_text(F.col("proof")), 256))
    return Counter(tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_hostile_rows(spark):
    sources = [None, "", "a", "é", "Z", "￿", "𐀀"]
    rows = [(i, sources[i % 7], None if i % 3 else "en", i, t) for i, t in enumerate(texts())]
    rows += [rows[6], rows[6], (None, "a", None, None, None), (None, None, "x", 1, "A"), (5, "alone", "en", 1, "ABC")]
    df = spark.createDataFrame(rows, SCHEMA)
    # Names that the operator uses inside.
    for name in ("rank", "n", "digest", "inner", "path", "tree", "block", "d0", "_at"):
        df = df.withColumn(name, F.lit(name))
    assert got(df.repartition(4)) == plain(rows, lowered)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 4097])
def test_sizes(spark, n):
    rows = [(i, "s" if i else "t", "en", i, f"Text {i}") for i in range(n)] if n < 300 else [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows, lowered)


def test_many_groups(spark):
    rows = [(i, f"s{i % 300:03}", "en", 1, "T") for i in range(900)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows, lowered)


def test_no_rows(spark):
    assert not got(spark.createDataFrame([], SCHEMA))


def test_no_row_holds_a_group(spark):
    """A group of all rows is ranked over many partitions and rolled up in blocks of a bounded size."""
    leaves = spark.range(0, 60_000, 1, 8).select(F.lit("s").alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes = ranked(leaves, "g", ["id"])
    assert nodes.where("rank <> id or n <> 60000").count() == 0
    blocks = roll_up(nodes.withColumn("inner", F.struct("id")), ["g"], "inner")
    held = blocks.select("block", F.aggregate("tree.kids", F.lit(0), lambda s, x: s + F.aggregate(x["kids"], F.lit(0), lambda t, y: t + F.size(y["kids"]))).alias("k"))
    assert sorted(tuple(r) for r in held.collect()) == [(i, min(4096, 60_000 - i * 4096)) for i in range(15)]

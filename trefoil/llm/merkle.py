"""Merkle manifest of a dataset: leaf, subroot, root and proof of every row.

A row's leaf is the digest of its fields. Leaves are ranked within their group; the
digits of the rank to base 16 say where a leaf lies in the tree. Digit columns are
grouped away one after the other, the last first: runs of 16 become a struct with
their digest, 16 of those the next, until a block of 4,096 leaves is one row of
nested structs. All these groupings share one shuffle, by block. Block digests are
the nodes of the next, 4,096 times shorter table, which is rolled up alike; the
roots of the groups at last are rolled up to the one root.

Proofs come back down: a transform and an explode open a nested block, each child
with the digests beside it, so siblings are never looked up. What lies above a block
(one row a block) is the one thing that meets it by its key.

Ranks need no sort within a task of a whole group: rows are range-partitioned and
written once, and only (partition, group) counts are summed up.

Defined cases: null fields are ``-``; a null group is a group and comes first; null
ids come first; rows that repeat an id are ordered by their leaf; a group of one
has its leaf as root; an empty table gives no rows. Only the columns named are read,
so others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, written

BASE, DIGITS = 16, 3
BLOCK = BASE ** DIGITS
_ROW_BITS = 33


def field(c: Column) -> Column:
    """A value with its size before it; null is a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def ranked(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) within the group, and ``n``, the group's size."""
    placed = leaves.orderBy(F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order])
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    # In a partition a group's rows follow one another, so a place is the distance from the first.
    spans = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(
        F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    met = placed.join(spans, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*leaves.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n")


def roll_up(nodes: DataFrame, key: list[str], inner: str) -> DataFrame:
    """``key, block, n, tree, digest``: one row of nested structs for each block of nodes.

    ``nodes`` has the key, ``rank`` and ``n`` within it, ``digest`` and ``inner``, a
    struct that goes along with a node. A level exists where more nodes than one are left.
    """
    block = nodes.select(
        *key, "n", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"),
        *[F.pmod(F.floor(F.col("rank") / BASE ** k), F.lit(BASE)).cast("int").alias(f"d{k}") for k in range(DIGITS)],
        F.struct("digest", F.col(inner).alias("inner")).alias("tree"))
    # The first grouping's shuffle is by the block alone, so the ones after it need none.
    block = block.repartition(*key, "block")
    for k in range(DIGITS):
        digits = [f"d{j}" for j in range(k + 1, DIGITS)]
        # Siblings in the order of their digit; a run holds at most 16.
        children = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "tree")))
        runs = block.groupBy(*key, "n", "block", *digits).agg(children["tree"].alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["digest"]), "")
        digest = F.when(F.col("n") > BASE ** k, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["digest"])
        block = runs.select(*key, "n", "block", *digits, F.struct(digest.alias("digest"), "kids").alias("tree"))
    return block.withColumn("digest", F.col("tree.digest"))


_NO_PATH = "array<struct<before:string,after:string>>"


def _opened(df: DataFrame, k: int, rest: list[str]) -> DataFrame:
    """One row for each child of ``tree``, with the level it adds to its path."""
    def child(x, i):
        others = lambda part: F.array_join(F.transform(part, lambda y: y["digest"]), "")
        kids = F.col("tree.kids")
        level = F.struct(
            others(F.slice(kids, F.lit(1), i)).alias("before"), others(F.slice(kids, i + 2, F.lit(BASE))).alias("after"))
        return F.struct(x.alias("tree"), level.alias("level"))

    df = df.select(*rest, "n", "path", F.explode(F.transform("tree.kids", child)).alias("_c"))
    # Where the level does not exist, the child is its parent.
    path = F.when(F.col("n") > BASE ** k, F.concat(F.array("_c.level"), "path")).otherwise(F.col("path"))
    return df.select(*rest, "n", path.alias("path"), F.col("_c.tree").alias("tree"))


def proofs(blocks: DataFrame, above: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """``inner`` of every node with its ``digest`` and ``path``, the levels from itself to the root.

    ``above`` has a row for each block: key, ``block``, ``path`` and the columns ``rest``.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*key, "block"]])
    rows = blocks.alias("b").join(above.alias("a"), same).select("b.n", "b.tree", "a.path", *[f"a.{c}" for c in rest])
    for k in reversed(range(DIGITS)):
        rows = _opened(rows, k, rest)
    return rows.select("tree.inner", "tree.digest", "path", *rest)


def _tree(nodes: DataFrame, key: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and ``(key, digest)`` of the roots; ``most`` is the largest group."""
    rounds = []
    while True:
        blocks = written(roll_up(nodes, key, "inner"), "blocks")
        rounds.append(blocks)
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds, blocks.select(*key, "digest")
        nodes = blocks.select(
            *key, F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest",
            F.struct("block").alias("inner"))


def _paths(rounds: list[DataFrame], above: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """Open the rounds of blocks, the last (the roots) first; ``above`` has key, ``path`` and ``rest``."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        found = proofs(blocks, above, key, list(dict.fromkeys([*key, *rest])))
        above = found.select(*key, F.col("inner.block").alias("block"), "path", *[c for c in rest if c not in key])
    return proofs(rounds[0], above, key, rest)


def manifest(
    df: DataFrame, fields: list[str], group: str, order: str, tampered: Column | None = None, fields_tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """``order`` column, ``leaf``, ``subroot``, ``root``, ``proof`` (path), ``folded_root`` and ``verified``.

    The leaf covers ``fields`` in their order. Where ``tampered`` holds, the folded
    root is that of a leaf with the columns ``fields_tampered`` in place of its own.
    """
    leaf = leaf_of(*[F.col(c) for c in fields])
    changed = leaf_of(*[(fields_tampered or {}).get(c, F.col(c)) for c in fields])
    seen = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    leaves = df.select(F.col(group).alias("_group"), F.col(order).alias("_id"), leaf.alias("digest"), seen.alias("_changed"))
    nodes = ranked(leaves, "_group", ["_id", "digest"])
    nodes = nodes.select("_group", "rank", "n", "digest", F.struct("_id", "_changed").alias("inner"))
    sizes = written(nodes.select("_group", "n", "rank").where("rank = 0").drop("rank"), "sizes")
    largest = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    rounds, subroots = _tree(nodes, ["_group"], largest[0] or 0)

    # The roots of the groups are the leaves of the last tree, a single group.
    tops = ranked(subroots.withColumn("_all", F.lit(0)), "_all", ["_group"])
    tops = tops.select("_all", "rank", "n", "digest", F.struct("_group").alias("inner"))
    top_rounds, root = _tree(tops, ["_all"], largest[1])
    start = root.select("_all", F.array().cast(_NO_PATH).alias("path"), F.col("digest").alias("root"))
    above = _paths(top_rounds, start, ["_all"], ["root"])
    above = written(above.select("inner._group", F.col("digest").alias("subroot"), "path", "root"), "roots")

    found = _paths(rounds, above, ["_group"], ["subroot", "root"])
    found = found.select(
        F.col("inner._id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"),
        fold(F.col("path"), F.coalesce("inner._changed", "digest")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_text(path: Column) -> Column:
    """All digests beside the way, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")

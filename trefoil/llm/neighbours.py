"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where the Euclidean distance is a metric and
falls as the cosine rises. Each shard of the table builds its own tree: a node
takes a vantage point and splits its vectors by the median distance to it. A
search keeps the distance of the best ``k`` found so far; a side of a node whose
least possible distance, by the triangle inequality, exceeds it cannot hold a
better one. That least distance is multiplied by ``factor`` first: factor one
gives exact search, larger ones prune more and may miss some.

Queries go to the shards in blocks: each shard row set meets each block of
queries once, by an equi-join on the block number, and returns ``k`` candidates a
query, whose cosines are computed from the original vectors in double precision.
Within a block the queries walk the tree together, so a node is one matrix
operation for all queries that reach it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as
query nor as candidate; rows with a null id neither. Vectors meet those of their
own length only, each length in shards of its own. Repeated rows count once; an
id with several vectors stands for the one that is nearest, as query too, and no
row is a candidate for a query of its own id. Ties go to the smaller id. Fewer
candidates than ``k`` are all returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

SHARD = 16384
BLOCK = 4096
LEAF = 256
# Bound on queries times points asked for times components in one search.
CELLS = 1 << 23


class Tree:
    """Vantage-point tree over unit vectors, as arrays of nodes."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        self.nodes: list[tuple] = []  # (vantage, radius, inner range, outer range) or (None, members)
        self._build(np.arange(len(vectors)), leaf)

    def _build(self, members: np.ndarray, leaf: int) -> None:
        # An explicit stack: equal vectors may make the tree lopsided, never the recursion deep.
        self.nodes.append(None)
        stack = [(0, members)]
        while stack:
            at, m = stack.pop()
            if len(m) <= leaf:
                self.nodes[at] = (None, m)
                continue
            v = int(m[0])
            rest = m[1:]
            d = _distance(self.vectors[v : v + 1], self.vectors[rest])[0]
            order = np.argsort(d, kind="stable")
            half = len(order) // 2
            inner, outer = order[:half], order[half:]
            here = len(self.nodes)
            self.nodes += [None, None]
            self.nodes[at] = (v, (d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]]), here, here + 1)
            stack += [(here, rest[inner]), (here + 1, rest[outer])]

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of the ``k`` nearest of each query (index -1 where there are fewer)."""
        n = len(queries)
        best_d = np.full((n, k), np.inf)
        best_i = np.full((n, k), -1)

        def offer(who, index, d):
            d = np.concatenate([best_d[who], d], axis=1)
            i = np.concatenate([best_i[who], np.broadcast_to(index, (len(who), len(index)))], axis=1)
            if d.shape[1] > k:
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                d, i = np.take_along_axis(d, top, 1), np.take_along_axis(i, top, 1)
            best_d[who], best_i[who] = d, i

        # The nearer side first: a query reaches a node with the least distance it may find there.
        stack = [(0, np.arange(n), np.zeros(n))]
        while stack:
            at, who, least = stack.pop()
            alive = least * factor <= best_d[who].max(axis=1)
            who = who[alive]
            if not len(who):
                continue
            node = self.nodes[at]
            if node[0] is None:
                if len(node[1]):
                    offer(who, node[1], _distance(queries[who], self.vectors[node[1]]))
                continue
            v, (in_low, in_high, out_low, out_high), inner, outer = node
            d = _distance(queries[who], self.vectors[v : v + 1])[:, 0]
            offer(who, np.array([v]), d[:, None])
            to_inner = np.maximum(np.maximum(d - in_high, in_low - d), 0)
            to_outer = np.maximum(np.maximum(d - out_high, out_low - d), 0)
            near_inner = to_inner <= to_outer
            for side in (~near_inner, near_inner):
                if side.any():
                    first, second = (inner, outer) if side is near_inner else (outer, inner)
                    a, b = (to_inner, to_outer) if side is near_inner else (to_outer, to_inner)
                    stack += [(second, who[side], b[side]), (first, who[side], a[side])]
        return best_i, best_d


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _sound(vector: str):
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _find(k: int, factor: float):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        all_ids, raw = _matrix(left)
        query_ids, query_raw = _matrix(right)
        # Equal vectors are one point of the tree, with their ids in order.
        raw, point = np.unique(raw, axis=0, return_inverse=True)
        by = np.lexsort((all_ids, point))
        ids, begins = all_ids[by], np.searchsorted(point[by], np.arange(len(raw) + 1))
        norm, query_norm = np.sqrt((raw * raw).sum(1)), np.sqrt((query_raw * query_raw).sum(1))
        tree, unit = Tree(raw / norm[:, None]), query_raw / query_norm[:, None]

        def among(who, index):
            """The ``k`` best other ids on the points ``index`` of the queries ``who``: place in ``who``, id, score."""
            q = np.repeat(np.arange(len(who)), index.shape[1])
            i = index.ravel()
            q, i = q[i >= 0], i[i >= 0]
            # The ids of a point are distinct: one more than asked, as the query's own id may be one.
            many = np.minimum(begins[i + 1] - begins[i], k + 1)
            q, i, place = np.repeat(q, many), np.repeat(i, many), np.repeat(begins[i], many)
            place += np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
            other = ids[place] != query_ids[who[q]]
            q, i, found = q[other], i[other], ids[place][other]
            score = (raw[i] * query_raw[who[q]]).sum(1) / (norm[i] * query_norm[who[q]])
            # An id once a query, by its nearest vector.
            order = np.lexsort((-score, found, q))
            q, found, score = q[order], found[order], score[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (found[1:] != found[:-1])
            q, found, score = q[new], found[new], score[new]
            order = np.lexsort((found, -score, q))
            q, found, score = q[order], found[order], score[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[top], found[top], score[top]

        # Several points may belong to one id: queries with fewer than ``k`` other ids ask again for more points.
        todo, size, kept = np.arange(len(query_ids)), k + 1, []
        while len(todo):
            again = []
            for who in np.array_split(todo, min(len(todo), -(-len(todo) * size * raw.shape[1] // CELLS))):
                q, found, score = among(who, tree.search(unit[who], size, factor)[0])
                short = (np.bincount(q, minlength=len(who)) < k) & (size < len(raw))
                kept.append(pa.table([query_ids[who[q[~short[q]]]], found[~short[q]], score[~short[q]]], schema=schema))
                again.append(who[short])
            todo, size = np.concatenate(again), min(size * 4, len(raw))
        return pa.concat_tables(kept)
    return run


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("vector").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return table.column("id").to_numpy(), flat.reshape(len(vectors), -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.15, vec_id: str = "vec_id", vector: str = "embedding",
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each row of ``queries``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    def clean(df):
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        return rows.where(F.col("id").isNotNull() & _sound("vector")).distinct()

    base, asked = written(clean(vectors), "vectors"), written(clean(queries), "queries")
    # One row per length of vectors: how many shards and blocks it has.
    width = F.size("vector").alias("width")
    parts = lambda df, n, name: df.groupBy(width).agg(F.ceil(F.count(F.lit(1)) / F.lit(n)).cast("long").alias(name))
    sizes = F.broadcast(written(parts(base, shard, "shards").join(parts(asked, block, "blocks"), "width"), "lengths"))
    # A shard is sent to each block of queries, a block to each shard: both by numbers, in bounded groups.
    place = F.xxhash64("id", "vector")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = base.withColumn("width", width).join(sizes, "width").select(
        "width", F.pmod(place, F.col("shards")).alias("shard"), each("blocks").alias("block"), "id", "vector")
    right = asked.withColumn("width", width).join(sizes, "width").select(
        "width", each("shards").alias("shard"), F.pmod(place, F.col("blocks")).alias("block"), "id", "vector")
    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _find(k, factor), "query_id long, vec_id long, score double"
    )
    # The best of every shard meet per query, after each has been cut to ``k``.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

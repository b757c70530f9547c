"""Hard negatives by a vertical scan of vectors, dimension by dimension (BOND).

Vectors lie in blocks, each a matrix with one row for each dimension and the least
and greatest value of every dimension. An anchor reads a block's dimensions in the
order of its own descending magnitudes. After every few, what the dimensions still
unread can add lies between two sums of their least and greatest products; vectors
that cannot reach what is sought with the greatest, or exceed it with the least,
leave the candidate bitmap. The few left when all dimensions are read have their
exact scores.

Two scans: first the nearest vectors of the anchor's label, in the blocks of that
label's bucket alone; each gives a window of scores. Then the best vectors of other
labels inside each window, in all blocks. What earlier blocks of a task found
raises the bound for later ones. A block is sent to a group of anchors only if
the extreme values of both leave some window within reach.

A bucket holds whole labels; one that is too large is divided into blocks by row, so
a label of any size fills many blocks. The anchors are a stated set of queries,
dealt in groups; their lists are merged by a ranked window.

Defined cases: rows with a null label or vector, or a null or non-finite component,
take no part; vectors meet only vectors of their own length; rows that repeat an id
are rows of their own, and no row is its own positive; equal scores go by id. A
negative positive score leaves its window empty. Scores must fit 53 bits, else the
job fails. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ROW, numbered, written

BLOCK_ROWS = 4096
GROUP_ANCHORS = 2048
# Blocks that one task holds beside a group of anchors.
TASK_BLOCKS = 16
# Dimensions read between two looks at the bitmap; the last number repeats.
STEPS = (4, 4, 8, 16)


def scan(a: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, live: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the vectors that ``prune`` leaves.

    ``prune(partial, least, greatest)`` says which partial sums may stay if the rest
    adds at least ``least`` and at most ``greatest``.
    """
    order = np.argsort(-np.abs(a), kind="stable")
    ends = np.stack([a * low, a * high])[:, order]
    rest = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0.0)
    least, greatest = rest(ends.min(axis=0)), rest(ends.max(axis=0))
    partial = np.zeros(len(live))
    at = k = 0
    while len(live):
        keep = prune(partial, least[at], greatest[at])
        if np.count_nonzero(keep) < len(live):
            live, partial = live[keep], partial[keep]
        if at == len(a) or not len(live):
            break
        step = order[at : at + STEPS[min(k, len(STEPS) - 1)]]
        read = columns[step] if len(live) == columns.shape[1] else columns[np.ix_(step, live)]
        partial = partial + a[step] @ read
        at, k = at + len(step), k + 1
    return live, partial


def best(k: int, *found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of (score, id, row) lists: highest score, then smallest id."""
    score, ids, rows = (np.concatenate(x) for x in zip(*found))
    if len(score) > k:
        # Ties with the k-th stay until ids decide.
        near = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids, rows = score[near], ids[near], rows[near]
    by = np.lexsort((rows, ids, -score))[:k]
    return score[by], ids[by], rows[by]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest, or minus infinity."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


_NONE = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))


class Block:
    """A block as it lies in a row of the table."""

    def __init__(self, row: dict):
        self.ids, self.rows, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows", "labels"))
        self.columns = np.frombuffer(row["columns"], f"<i{row['width']}").reshape(-1, len(self.ids)).astype(np.float64)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.greatest = float(np.abs(self.columns).max(initial=0))

    def exact(self, a: np.ndarray) -> None:
        if float(np.abs(a).max(initial=0)) * self.greatest * max(1, len(a)) >= 2.0 ** 53:
            raise ValueError("scores do not fit 53 bits")

    def some(self, places: np.ndarray, score: np.ndarray):
        return score, self.ids[places], self.rows[places]


def nearest_of_label(anchor: dict, blocks: list[Block], k: int):
    """The ``k`` best other rows of the anchor's label."""
    a, top = anchor["x"], _NONE
    for b in blocks:
        b.exact(a)
        live = np.flatnonzero((b.labels == anchor["label"]) & (b.rows != anchor["row"]))
        reached = top[0][-1] if len(top[0]) == k else -np.inf

        def prune(partial, least, greatest):
            return partial + greatest >= max(reached, kth(partial, k) + least)

        top = best(k, top, b.some(*scan(a, b.columns, b.low, b.high, live, prune)))
    return top


def best_in_windows(anchor: dict, blocks: list[Block], windows: list[tuple[int, int]], k: int):
    """For each (least, greatest) score the ``k`` best rows of other labels inside it."""
    a, tops = anchor["x"], [_NONE] * len(windows)
    for b in blocks:
        b.exact(a)
        live = np.flatnonzero(b.labels != anchor["label"])
        floors = [max(low, t[0][-1]) if len(t[0]) == k else low for (low, _), t in zip(windows, tops)]

        def prune(partial, least, greatest):
            keep = np.zeros(len(partial), bool)
            for (low, high), floor in zip(windows, floors):
                # Those that are sure to end inside the window bound the others.
                sure = partial[(partial + least >= low) & (partial + greatest <= high)]
                keep |= (partial + greatest >= max(floor, kth(sure, k) + least)) & (partial + least <= high)
            return keep

        places, score = scan(a, b.columns, b.low, b.high, live, prune)
        for w, (low, high) in enumerate(windows):
            inside = (score >= low) & (score <= high)
            if inside.any():
                tops[w] = best(k, tops[w], b.some(places[inside], score[inside]))
    return tops


_BLOCKS = "dim int, bucket long, sub long, n int, width int, ids binary, rows binary, labels binary, columns binary, low array<long>, high array<long>"


def _to_block(table: pa.Table) -> pa.Table:
    dim, bucket, sub = (table.column(c)[0].as_py() for c in ("dim", "bucket", "sub"))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim).T
    width = 4 if abs(x).max(initial=0) < 2 ** 31 else 8
    flat = lambda c: table.column(c).to_numpy().astype("<i8").tobytes()
    return pa.Table.from_pydict({
        "dim": pa.array([dim], pa.int32()), "bucket": [bucket], "sub": [sub], "n": pa.array([table.num_rows], pa.int32()),
        "width": pa.array([width], pa.int32()), "ids": [flat("id")], "rows": [flat(ROW)], "labels": [flat("label")],
        "columns": [np.ascontiguousarray(x).astype(f"<i{width}").tobytes()],
        "low": pa.array([x.min(axis=1).tolist()], pa.list_(pa.int64())), "high": pa.array([x.max(axis=1).tolist()], pa.list_(pa.int64())),
    })


def _anchors(table: pa.Table) -> list[dict]:
    out = []
    for r in table.select([c for c in table.column_names if c in (ROW, "id", "label", "x", "positives")]).to_pylist():
        out.append({"row": r[ROW], "id": r["id"], "label": r["label"], "x": np.array(r["x"], np.float64), "positives": r.get("positives")})
    return out


def _blocks(table: pa.Table) -> list[Block]:
    return [Block(r) for r in table.select(["ids", "rows", "labels", "width", "columns"]).to_pylist()]


_POSITIVES = f"{ROW} long, score long, positive_id long, positive_row long"


def _scan_positives(k: int):
    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        held, out = _blocks(blocks), ([], [], [], [])
        for anchor in _anchors(anchors):
            score, ids, rows = nearest_of_label(anchor, held, k)
            for column, values in zip(out, ([anchor["row"]] * len(score), score.astype(np.int64), ids, rows)):
                column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], [ROW, "score", "positive_id", "positive_row"])
    return run


_NEGATIVES = f"{ROW} long, place int, anchor_id long, positive_id long, positive_score long, score long, negative_id long, negative_row long"


def _window(score: int, least: int, greatest: int) -> tuple[int, int]:
    """Scores from ``least`` to ``greatest`` hundredths of a score, as whole numbers."""
    return -(-least * score // 100), greatest * score // 100


def _scan_negatives(k: int, least: int, greatest: int):
    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        held = _blocks(blocks)
        out = {c.split()[0]: [] for c in _NEGATIVES.split(", ")}
        for anchor in _anchors(anchors):
            positives = anchor["positives"]
            windows = sorted({_window(p["score"], least, greatest) for p in positives})
            tops = dict(zip(windows, best_in_windows(anchor, held, windows, k)))
            for p in positives:
                score, ids, rows = tops[_window(p["score"], least, greatest)]
                n = len(score)
                for column, values in zip(out.values(), (
                    [anchor["row"]] * n, [p["place"]] * n, [anchor["id"]] * n, [p["positive_id"]] * n, [p["score"]] * n,
                    score.astype(np.int64), ids, rows,
                )):
                    column.extend(values)
        kinds = {c.split()[0]: pa.int32() if c.endswith(" int") else pa.int64() for c in _NEGATIVES.split(", ")}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})
    return run


def _only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns under identities of their own, so that both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in columns])


_ASKED, _MET = (ROW, "id", "label", "x"), ("ids", "rows", "labels", "width", "columns")


def _divided(rows: DataFrame, key: list[str], size: int, name: str) -> DataFrame:
    """Divide the rows of each key into parts of about ``size`` by their number; adds ``name`` and ``n_<name>``."""
    counts = written(rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias(f"n_{name}")), "counts")
    return rows.join(counts, key).withColumn(name, F.pmod(F.xxhash64(ROW), F.col(f"n_{name}")))


def hard_negatives(
    df: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 10, least: int = 30, greatest: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``. A negative's score lies from ``least`` to
    ``greatest`` hundredths of the positive's.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    parts = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(vector).isNotNull() & label.isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = numbered(
        rows, F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        parts.alias("x"), F.size(vector).cast("int").alias("dim"))
    total, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    buckets = max(1, -(-total // BLOCK_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    blocks = _divided(rows, ["dim", "bucket"], BLOCK_ROWS, "sub").groupBy("dim", "bucket", "sub").applyInArrow(_to_block, _BLOCKS)
    blocks = written(blocks, "blocks")
    # Extreme values alone, a row for each block.
    outline = written(blocks.select("dim", "bucket", "sub", "low", "high"), "outlines")

    # Nearest of the label: the anchors of a bucket meet the blocks of that bucket.
    anchors = _divided(rows.where("asks"), ["dim", "bucket"], GROUP_ANCHORS, "part").select(ROW, "id", "label", "x", "dim", "bucket", "part", "n_part")
    of_bucket = outline.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / TASK_BLOCKS).cast("long").alias("splits"))
    groups = written(anchors.select("dim", "bucket", "n_part").distinct().join(of_bucket, ["dim", "bucket"]), "groups")
    until = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asked = anchors.join(groups.select("dim", "bucket", "splits"), ["dim", "bucket"]).withColumn("split", F.explode(until("splits")))
    met = blocks.join(groups, ["dim", "bucket"]).withColumn("part", F.explode(until("n_part")))
    met = met.withColumn("split", F.pmod(F.col("sub"), F.col("splits")))
    key = ["dim", "bucket", "part", "split"]
    asked, met = _only(asked, *key, *_ASKED), _only(met, *key, *_MET)
    found = asked.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_scan_positives(positives), _POSITIVES)
    place = F.row_number().over(Window.partitionBy(ROW).orderBy(F.desc("score"), "positive_id", "positive_row"))
    found = found.withColumn("place", place).where(F.col("place") <= positives)
    found = found.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))

    # Windows: groups of anchors from neighbouring buckets meet the blocks within their reach.
    n_groups = max(1, -(-asking // GROUP_ANCHORS))
    asking_rows = rows.where("asks").withColumn("group", F.floor(F.col("bucket") * n_groups / buckets).cast("long"))
    asking_rows = _divided(asking_rows.join(found, ROW), ["dim", "group"], GROUP_ANCHORS, "part")
    asking_rows = written(asking_rows.select(ROW, "id", "label", "x", "dim", "group", "part", "positives"), "anchors")
    ends = asking_rows.select("dim", "group", "part", F.posexplode_outer("x").alias("d", "v"), F.array_min("positives.score").alias("p"))
    reach = ends.groupBy("dim", "group", "part", "d").agg(F.min("v").alias("v_low"), F.max("v").alias("v_high"), F.min("p").alias("p"))
    reach = reach.groupBy("dim", "group", "part").agg(
        F.min("p").alias("p"), F.array_sort(F.collect_list(F.struct("d", "v_low", "v_high"))).alias("ends"))
    reach = written(reach, "reach")
    # A stated query set against all blocks: one row of extreme values for each group and block.
    listed = reach.groupBy("dim").agg(F.collect_list(F.struct("group", "part")).alias("groups"))
    pairs = outline.join(listed, "dim").select("dim", "bucket", "sub", "low", "high", F.inline("groups")).join(reach, ["dim", "group", "part"])
    products = F.transform("ends", lambda e, i: F.greatest(
        e["v_low"] * F.get("low", i), e["v_low"] * F.get("high", i), e["v_high"] * F.get("low", i), e["v_high"] * F.get("high", i)))
    # Vectors without components have no extreme values and the score 0.
    most = F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    splits = max(1, -(-outline.count() // TASK_BLOCKS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_groups))
    pairs = pairs.where(most * 100 >= F.greatest("p", F.lit(0)) * least).select(
        "dim", "bucket", "sub", "group", "part", F.pmod(F.xxhash64("bucket", "sub"), F.lit(splits)).alias("split"))
    pairs = written(pairs, "pairs")
    key = ["dim", "group", "part", "split"]
    asked = asking_rows.join(pairs.select(*key).distinct(), ["dim", "group", "part"])
    met = blocks.join(pairs, ["dim", "bucket", "sub"])
    asked, met = _only(asked, *key, *_ASKED, "positives"), _only(met, *key, *_MET)
    out = asked.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_scan_negatives(negatives, least, greatest), _NEGATIVES)
    rank = F.row_number().over(Window.partitionBy(ROW, "place").orderBy(F.desc("score"), "negative_id", "negative_row"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))

"""Token ids in a compact binary format, written in document order.

Ids are replaced by their frequency rank over the whole corpus, so that the
common ones fit one byte. A value takes one to four whole bytes; its length is
held apart in control bytes, two bits a value and four values a byte. Decoding is
a lookup: 256 control bytes map to four lengths each, running sums of the lengths
give all places at once.

A dataset is a folder with two Parquet tables, which Spark commits as a whole:
``ranks`` (``rank``, ``id``) and ``blocks``. A block holds whole documents of one
range of document ids: ``part`` and ``block`` (its place), ``start`` (ids of the
part before it), ``doc_ids``, ``lengths``, ``control`` and ``data``.

Defined cases: a null text is empty and still ends with the end id; null ids come
last; repeated rows are written one after the other; an empty table gives no
blocks. A document is never divided, however long.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.shared import new_path
from .common import ROW, written
from .tokens import encoder

BLOCK_IDS = 1 << 20
_ROWS = 2048
# Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.nonzero(lengths > k)[0]
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenise(path: str, spaces: str, end_id: int, special: bool):
    def run(batches):
        for batch in batches:
            enc = encoder(path, spaces, special)
            width = np.dtype(enc.dtype).itemsize
            # Some rows at a time, so that their ids fit one Arrow array.
            for k in range(0, batch.num_rows, _ROWS):
                some = batch.slice(k, _ROWS)
                ids, ends = enc.column(some.column(2))
                ids = np.insert(ids, ends, end_id)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
                found = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), found.cast(pa.binary()), pa.array(np.full(len(ends), width, np.int32))],
                    ["doc_id", ROW, "ids", "width"],
                )
    return run


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        ids, width = batch.column(0), batch.column(1)
        for w in pc.unique(width).to_pylist():
            # All ids of a batch lie one after the other; they are counted at once.
            some = ids.filter(pc.equal(width, w))
            n = np.bincount(np.frombuffer(b"".join(some.to_pylist()), f"<u{w}"), minlength=len(total))
            n[: len(total)] += total
            total = n
    found = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])


BLOCKS = "part int, block int, start long, doc_ids array<long>, lengths array<int>, control binary, data binary"


def _blocks(rank_of: np.ndarray, block_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs, parts, held = [], [], 0

        def out():
            nonlocal block, start, docs, parts, held
            control, data = encode_values(np.concatenate(parts))
            row = {"part": [part], "block": [block], "start": [start], "doc_ids": [docs], "lengths": [[len(p) for p in parts]],
                   "control": [control], "data": [data]}
            block, start, docs, parts, held = block + 1, start + held, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for doc, ids, width in zip(*(batch.column(k).to_pylist() for k in range(3))):
                values = rank_of[np.frombuffer(ids, f"<u{width}")]
                if parts and held + len(values) > block_ids:
                    yield out()
                docs.append(doc)
                parts.append(values)
                held += len(values)
        if parts:
            yield out()
    return run


def write_ids(
    df: DataFrame, tokenizer: str, spaces: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS,
    special: bool = False,
) -> str:
    """Tokenise ``df`` and write the ids in ascending document order; returns the folder."""
    spark = df.sparkSession
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias(ROW), F.col(text).alias("text"))
    # Written once: the row numbers and ids of this evaluation hold for all that follows.
    ids = written(source.mapInArrow(_tokenise(tokenizer, spaces, end_id, special), f"doc_id long, {ROW} long, ids binary, width int"), "ids")
    # One row per id of the vocabulary at most.
    counts = ids.select("ids", "width").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy()
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    path = new_path(spark, "token-ids")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ids.repartitionByRange(parts, F.asc_nulls_last("doc_id"), F.asc(ROW)).sortWithinPartitions(F.asc_nulls_last("doc_id"), ROW)
    blocks = placed.select("doc_id", "ids", "width").mapInArrow(_blocks(rank_of, block_ids), BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _decode(id_of: np.ndarray, with_ids: bool):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                lengths = np.array(col["lengths"][k], np.int64)
                ids = id_of[decode_values(col["control"][k], col["data"][k], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                raw, starts = ids.tobytes(), ends - lengths
                arrays = [
                    pa.array(col["doc_ids"][k], pa.int64()), pa.array(starts + col["start"][k] + col["before"][k], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.append(starts, ends[-1:]), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a dataset: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, ``ids``."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy().astype("<u4")
    # One row per part, as many as the write had tasks.
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    found = blocks.join(F.broadcast(offsets), "part").select("start", "before", "doc_ids", "lengths", "control", "data")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return found.mapInArrow(_decode(ranks, with_ids), schema)

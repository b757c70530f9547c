"""Removal of repeated byte strings, by suffix arrays over the places that can repeat.

Every string of ``length`` bytes (a window) selects one of its own shorter
strings, the one with the smallest hash, as its anchor. Equal windows select equal
anchors at the same place inside them, so windows whose anchor hash occurs once in
the corpus are unique. Neighbouring windows with one anchor form a stretch; a
document has about one stretch in 150 bytes, and only their hashes, places and
digests are shuffled.

Stretches with equal digests repeat as a whole. Where stretches share an anchor
but differ, one of each kind goes, with its bytes, to the shard of its anchor. A
shard builds one suffix array by induced sorting (``suffixes``) and the permuted
common prefixes; windows that share ``length`` bytes with a neighbour in the order
repeat. An anchor with more different stretches than a task should hold
(``hot``) is settled window by window with a digest count instead, which gives the
same answer. Per document the marked windows are merged and cut out.

Defined cases: a null text is empty; texts under ``length`` bytes lose nothing;
copies of whole texts are folded first and lose everything if long enough;
matches never cross documents; repeated rows count as copies. Strings are judged
on the input. Other columns are kept, a text that ends in half a character keeps
its bytes (``kept`` is binary).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ROW, written
from .jaccard import _TABLE, _mix, _powers
from .suffixes import permuted_common_prefixes, suffix_array

LENGTH = 400
ANCHOR = 100
HOT = 20_000
SHARD_BYTES = 1 << 19
_CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def stretches(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each stretch of a text."""
    hashes, firsts, counts = [], [], []
    for a in range(0, max(0, len(raw) - length + 1), _CHUNK):
        part = raw[a : a + _CHUNK + length - 1]
        up, down = _powers(1 << max(12, int(len(part)).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[part] * up[: len(part)])])
        n = len(part) - anchor + 1
        h = _mix((sums[anchor:] - sums[:n]) * down[:n])
        # Equal hashes: the last one wins, as its place is stored from the far end.
        key = (h & ~_PLACE) | (_PLACE - np.arange(n, dtype=np.uint64))
        width = length - anchor + 1
        rows = -(-n // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        grid[:n] = key
        grid = grid.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
        place = (_PLACE - (least & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        hashes.append(h[place[first]])
        firsts.append(first + a)
        counts.append(np.diff(np.append(first, windows)))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts)


_FOUND = pa.list_(pa.struct([("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int32()), ("n", pa.int32())]))


def _scan(length: int, anchor: int):
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in _few(batches):
            sizes, digests, packed, found = [], [], [], []
            offsets, parts = [0], []
            for text in batch.column("_text").to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).digest())
                packed.append(pack(data))
                h, first, n = stretches(np.frombuffer(data, np.uint8), length, anchor)
                ends = first + n + (length - 1)
                d = np.frombuffer(b"".join([
                    hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(first.tolist(), ends.tolist())
                ]), np.int64).reshape(-1, 2)
                parts.append((h.view(np.int64), d[:, 0], d[:, 1], first.astype(np.int32), n.astype(np.int32)))
                offsets.append(offsets[-1] + len(h))
            columns = [pa.array(np.concatenate([p[k] for p in parts])) for k in range(5)]
            structs = pa.StructArray.from_arrays(columns, fields=list(_FOUND.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("_in"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)],
                [ROW, "_in", "n_bytes", "digest", "packed", "found"])
    return run


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _few(batches, rows: int = 256):
    """Slices of batches, so that a task holds the texts of a few rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _cut(length: int):
    """Bytes of the stretches asked for, read from their documents."""
    def run(batches):
        for batch in _few(batches):
            data = [_unpack(x) for x in batch.column("packed").to_pylist()]
            rows = {c: [] for c in ("shard", "anchor", "d1", "d2", "bytes")}
            for text, wanted in zip(data, batch.column("wanted").to_pylist()):
                for w in wanted:
                    for c in ("shard", "anchor", "d1", "d2"):
                        rows[c].append(w[c])
                    rows["bytes"].append(text[w["first"] : w["first"] + w["n"] + length - 1])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                [("shard", pa.int64()), ("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bytes", pa.binary())]))
    return run


_MARKS = "anchor long, d1 long, d2 long, marks array<int>"
_MARKS_SCHEMA = pa.schema([("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("marks", pa.list_(pa.int32()))])


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some byte strings, where in it a window begins that also begins elsewhere in them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    s = np.ones(begins[-1] + 1, np.uint16)
    for b, p in zip(begins, parts):
        s[b : b + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 2
    s[-1] = 0
    order = suffix_array(s, 258)
    shared, before = permuted_common_prefixes(s, order)
    hit = np.zeros(len(s), bool)
    long = np.flatnonzero(shared >= length)
    hit[long] = True
    hit[before[long]] = True
    out = []
    for b, n in zip(begins, sizes):
        out.append(np.flatnonzero(hit[b : b + max(0, n - length + 1)]))
    return out


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        marks = repeated_windows(table.column("bytes").to_pylist(), length)
        found = np.array([len(m) > 0 for m in marks], bool)
        kept = table.select(["anchor", "d1", "d2"]).filter(pa.array(found))
        return pa.table([*kept.columns, pa.array([m.astype(np.int32) for m in marks if len(m)], pa.list_(pa.int32()))], schema=_MARKS_SCHEMA)
    return run


def _window_digests(length: int):
    def run(batches):
        for batch in batches:
            for anchor, d1, d2, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "d1", "d2", "bytes"))):
                n = len(data) - length + 1
                w = np.frombuffer(b"".join([hashlib.blake2b(data[k : k + length], digest_size=16).digest() for k in range(n)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * n, pa.int64()) for x in (anchor, d1, d2)] + [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.arange(n, dtype=np.int32))],
                    ["anchor", "d1", "d2", "w1", "w2", "at"])
    return run


def _remove(length: int):
    def run(batches):
        for batch in _few(batches):
            sizes, removed, spans, kept = [], [], [], []
            for packed, marks in zip(batch.column("packed").to_pylist(), batch.column("marks")):
                data = np.frombuffer(_unpack(packed), np.uint8)
                flag = np.zeros(len(data) + 1, np.int32)
                for m in marks:
                    if m["starts"].is_valid:
                        at = m["starts"].values.to_numpy() + m["first"].as_py()
                    else:
                        at = np.arange(m["n"].as_py()) + m["first"].as_py()
                    np.add.at(flag, at, 1)
                    np.add.at(flag, at + length, -1)
                gone = np.cumsum(flag[:-1]) > 0
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                [ROW, "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(
    df: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, shard_bytes: int = SHARD_BYTES,
    with_kept: bool = True,
) -> DataFrame:
    """``df`` without its text, and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, ``kept``."""
    rest = [c for c in df.columns if c != text]
    inside = F.struct(*[df[c].alias(f"c{k}") for k, c in enumerate(rest)]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    source = df.select(F.monotonically_increasing_id().alias(ROW), inside.alias("_in"), F.col(text).alias("_text"))
    schema = (f"{ROW} long, _in {source.schema['_in'].dataType.simpleString()}, n_bytes long, digest binary, packed binary, "
              "found array<struct<anchor:bigint,d1:bigint,d2:bigint,first:int,n:int>>")
    docs = written(source.mapInArrow(_scan(length, anchor), schema), "scanned")

    # Copies of whole texts fold into their smallest row.
    texts = written(docs.groupBy("digest").agg(F.min(ROW).alias("head"), F.count(F.lit(1)).alias("copies")), "texts")
    repeated_head = texts.where("copies > 1").select(F.col("head").alias(ROW))
    copies = docs.select(ROW, "digest").join(texts.select("digest", "head", "copies"), "digest")
    not_heads = written(copies.where(F.col(ROW) != F.col("head")).select(ROW), "copies")
    found = docs.select(ROW, "found").join(not_heads, ROW, "left_anti").select(ROW, F.inline("found"))
    again = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("anchor"), "anchors")
    found = written(found.join(again, "anchor"), "stretches")

    kinds = found.groupBy("anchor", "d1", "d2").agg(
        F.count(F.lit(1)).alias("uses"), F.min(F.struct(ROW, "first")).alias("at"), F.first("n").alias("n"))
    kinds = written(kinds, "kinds")
    mixed = kinds.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("uses") == 1, 1)).alias("single"), F.sum(F.col("n") + (length - 1)).alias("bytes"))
    mixed = written(mixed.where("kinds > 1 and single > 0"), "mixed")
    total = mixed.agg(F.sum("bytes")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    wanted = kinds.join(mixed.select("anchor", "kinds"), "anchor").select(
        F.col(f"at.{ROW}").alias(ROW), F.struct(
            F.when(F.col("kinds") <= hot, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(-1).alias("shard"),
            "anchor", "d1", "d2", F.col("at.first").alias("first"), "n").alias("w"))
    wanted = wanted.groupBy(ROW).agg(F.collect_list("w").alias("wanted"))
    pieces = docs.select(ROW, "packed").join(wanted.hint("shuffle_hash"), ROW).select("packed", "wanted")
    pieces = written(pieces.mapInArrow(_cut(length), "shard long, anchor long, d1 long, d2 long, bytes binary"), "cuts")
    marks = pieces.where("shard >= 0").groupBy("shard").applyInArrow(_shard(length), _MARKS)
    windows = pieces.where("shard < 0").mapInArrow(
        _window_digests(length), "anchor long, d1 long, d2 long, w1 long, w2 long, at int")
    windows = written(windows, "windows")
    twice = written(windows.groupBy("anchor", "w1", "w2").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").drop("uses"), "twice")
    by_window = windows.join(twice, ["anchor", "w1", "w2"]).groupBy("anchor", "d1", "d2").agg(F.collect_list("at").alias("marks"))
    single = written(marks.union(by_window), "marks")

    # Kinds used twice repeat as a whole (no list), others where they are marked.
    whole = kinds.where("uses > 1").select("anchor", "d1", "d2", F.lit(None).cast("array<int>").alias("marks"))
    once = single.join(kinds.where("uses = 1").select("anchor", "d1", "d2"), ["anchor", "d1", "d2"])
    verdicts = written(whole.unionByName(once.select("anchor", "d1", "d2", "marks")), "verdicts")
    per_row = found.join(verdicts, ["anchor", "d1", "d2"]).groupBy(ROW).agg(
        F.collect_list(F.struct("first", "n", F.col("marks").alias("starts"))).alias("marks"))
    # Whole copies need no list; the few bytes of short ones stay.
    per_row = per_row.join(repeated_head, ROW, "left_anti")
    changed = docs.select(ROW, "packed").join(per_row.hint("shuffle_hash"), ROW).mapInArrow(
        _remove(length), f"{ROW} long, n_removed long, n_spans long, kept binary")
    if not with_kept:
        changed = changed.select(ROW, "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    else:
        changed = changed.withColumn("sha", F.sha2("kept", 256))
    changed = written(changed, "changed")
    is_copy = not_heads.union(repeated_head).withColumn("copy", F.lit(True))
    base = docs.select(ROW, "_in", "n_bytes", "digest", *["packed"] * with_kept)
    out = base.join(changed, ROW, "left").join(is_copy, ROW, "left")
    whole_gone = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    columns = [F.col("_in")[f"c{k}"].alias(c) for k, c in enumerate(rest)] + [
        F.col("n_bytes"),
        F.when(whole_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole_gone, empty).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    ]
    if not with_kept:
        return out.select(*columns)
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in out.select(*columns).schema)
    names = [f.name for f in out.select(*columns).schema]
    kept = F.when(whole_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")
    return out.select(*columns, kept, "packed").mapInArrow(_with_kept(names), schema + ", kept binary")


def _with_kept(names: list[str]):
    def run(batches):
        for batch in batches:
            kept = [_unpack(p) if k is None else k for k, p in zip(batch.column("kept").to_pylist(), batch.column("packed").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(kept, pa.binary())], [*names, "kept"])
    return run

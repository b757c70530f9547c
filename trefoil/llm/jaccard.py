"""Near-duplicate join on word shingles with Bayesian pruning of candidates.

A document is the set of its five-word shingles. Documents with the same set
fold into one class before anything is compared, so copies cost nothing.

Candidates. Each class has ``BANDS * ROWS`` MinHash values; two classes that
agree on all values of one band are tied together. A pair at the threshold is
tied by none of its 48 bands with a probability below one in a million, and
higher similarities far less. Ties are stars (member, smallest member of its
band), one row per class and band, and their connected components are the groups
that can hold links: no pairs are listed.

Pruning and verification. The members of a group are dealt into blocks of bounded
size by a hash, and each pair of blocks is one task. There, pairs are compared
MinHash value by value, 32 at a time. After each step the posterior probability
that their similarity reaches the threshold is known from the number of agreeing
values (uniform prior), and pairs below ``tolerance`` are dropped. The rest is
verified on the exact shingle sets. A task returns counts and stars per member,
never its pairs. Components of the verified stars are the classes of near copies.

Defined cases: words are runs of anything but white space; a text of one to four
words is one shingle; a null or empty text has none and is a class by itself with
no links. Repeated rows are copies. The class id is the smallest document id in
it (null ids last, then the row).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ROW, written
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 48, 6
STEP = 32
TOLERANCE = 1e-6
BLOCK = 512
PIECE = 1 << 20
# MinHash values kept for the pruning, two bytes of each; chance agreement of those only keeps more candidates.
KEPT = 128

_WHITE = b" \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(_WHITE)] = True


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


_POWER = 0x9E3779B97F4A7C15


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    a = np.full(n, _POWER, np.uint64)
    b = np.full(n, pow(_POWER, -1, 1 << 64), np.uint64)
    a[0] = b[0] = 1
    return np.multiply.accumulate(a), np.multiply.accumulate(b)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64))


def _words(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a piece of text."""
    solid = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(1 << max(12, int(len(raw)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * up[: len(raw)])])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        # Long texts go in pieces that end at white space, so that no word is divided.
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            blank = np.flatnonzero(_BLANK[raw[end:]])
            end = end + int(blank[0]) if len(blank) else len(raw)
        parts.append(_words(raw[at:end]))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n])
    return np.unique(out)


_FACTORS = (_odd(BANDS * ROWS, 11) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)


def minhashes(found: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` smallest values under multiplicative permutations of 32-bit hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048][None, :] * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x2545F4914F6CDD1D) + v[:, k])
    return key.view(np.int64)


def _sign(batches):
    """Digest of the set, its size, band keys, short MinHash values and the packed text of each row."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        digest, size, keys, sig, packed = [], [], [], [], []
        for text in batch.column("_text").to_pylist():
            s = shingles(text)
            values = minhashes(s) if len(s) else None
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            size.append(len(s))
            keys.append(band_keys(values) if len(s) else None)
            sig.append((values[:KEPT] >> np.uint32(16)).astype("<u2").tobytes() if len(s) else None)
            packed.append(None if text is None else pack(text.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("_in"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()),
             pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(packed, pa.binary())],
            [ROW, "_in", "digest", "size", "keys", "sig", "packed"])


def _unpack(packed: bytes | None) -> str | None:
    import zstandard

    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


@functools.lru_cache(8)
def least_matches(threshold: float, tolerance: float, total: int, step: int = STEP) -> tuple[int, ...]:
    """Agreeing values needed after each step for the posterior to stay at or above the tolerance.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1);
    its upper tail at the threshold is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(step, total + 1, step):
        tail = lambda m: sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance or m == n))
    return tuple(out)


def candidate_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, tolerance: float, half: bool):
    """Pairs (index in ``a``, index in ``b``) that survive the size bound and the Bayesian pruning; ``half``: ``a`` is ``b``."""
    small, big = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    possible = small >= threshold * big - 1e-9
    i, j = np.nonzero(np.triu(possible, 1) if half else possible)
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance, a.shape[1])):
        cols = slice(k * STEP, (k + 1) * STEP)
        x, y = np.ascontiguousarray(a[:, cols]), np.ascontiguousarray(b[:, cols])
        for s in range(0, len(i), 1 << 16):
            t = slice(s, s + (1 << 16))
            matches[t] += (x[i[t]] == y[j[t]]).sum(axis=1)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
        if not len(i):
            break
    return i, j


def exact_pairs(sets_a: list, sets_b: list, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, from the sets themselves."""
    if not len(i):
        return np.zeros(0, bool)
    ia, pos_a = np.unique(i, return_inverse=True)
    jb, pos_b = np.unique(j, return_inverse=True)
    na = np.array([len(sets_a[x]) for x in ia])
    nb = np.array([len(sets_b[x]) for x in jb])
    value = np.concatenate([sets_a[x] for x in ia] + [sets_b[x] for x in jb])
    row = np.concatenate([np.repeat(np.arange(len(ia)), na), np.repeat(np.arange(len(jb)) + len(ia), nb)])
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    # Shingles of one document alone are in no intersection.
    shared = count[code] > 1
    row, code = row[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    common = np.zeros((len(ia), len(jb)), np.float32)
    width = int(code[-1]) + 1 if len(code) else 0
    for s in range(0, width, 4096):
        lo, hi = np.searchsorted(code, [s, s + 4096])
        m = np.zeros((len(ia) + len(jb), min(4096, width - s)), np.float32)
        m[row[lo:hi], code[lo:hi] - s] = 1
        common += m[: len(ia)] @ m[len(ia) :].T
    both = common[pos_a, pos_b].astype(np.int64)
    return both >= threshold * (na[pos_a] + nb[pos_b] - both) - 1e-9


def _verify(threshold: float, tolerance: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rows, copies, size = (table.column(c).to_numpy() for c in (ROW, "copies", "size"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(rows), -1)
        # A block that meets itself comes once, as side 2: each unordered pair counts once.
        one = side[0] == 2
        left = np.flatnonzero(side != 1)
        right = left if one else np.flatnonzero(side == 1)
        i, j = candidate_pairs(sig[left], sig[right], size[left], size[right], threshold, tolerance, one)
        if len(i):
            packed = table.column("packed")
            sets = {}
            for k in np.unique(np.concatenate([left[i], right[j]])):
                sets[k] = shingles(_unpack(packed[int(k)].as_py()))
            good = exact_pairs([sets.get(k) for k in left], [sets.get(k) for k in right], i, j, threshold)
            i, j = left[i[good]], right[j[good]]
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        # The smallest partner of each member ties it to the others of these blocks.
        label = rows.copy()
        while len(i):
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            if (low == label).all():
                break
            label = low
        hit = np.flatnonzero(links)
        return pa.table({ROW: pa.array(rows[hit], pa.int64()), "tied": pa.array(label[hit], pa.int64()), "links": pa.array(links[hit], pa.int64())})
    return run


def _signed(df: DataFrame, text: str) -> DataFrame:
    rest = [df[c].alias(f"c{k}") for k, c in enumerate(df.columns) if c != text]
    inside = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    source = df.select(F.monotonically_increasing_id().alias(ROW), inside.alias("_in"), F.col(text).alias("_text"))
    schema = f"{ROW} long, _in {source.schema['_in'].dataType.simpleString()}, digest binary, size long, keys array<long>, sig binary, packed binary"
    # Written once, so that row numbers hold for all that follows; later steps read the columns they need.
    return written(source.mapInArrow(_sign, schema), "signed")


def _classes(signed: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Row, the class it belongs to (a row number) and its links."""
    # Classes of equal sets. A set's row is its smallest; its copies are counted.
    sets = signed.where("digest is not null").groupBy("digest").agg(F.min(ROW).alias("set_row"), F.count(F.lit(1)).alias("copies"))
    sets = written(sets, "sets")
    heads = signed.select(ROW, "size", "keys", "sig").join(
        sets.select(F.col("set_row").alias(ROW), "copies").hint("shuffle_hash"), ROW)
    heads = written(heads, "heads")

    keys = heads.select(F.col(ROW).alias("node"), F.explode("keys").alias("key"))
    # Members of a band beside the smallest; a band of one member has none.
    smallest = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    smallest = written(smallest.select("key", "head"), "bands")
    ties = keys.join(smallest, "key").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()
    group = written(components(ties), "groups")
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    sizes = written(sizes.select("component", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "sizes")
    member = group.join(sizes, "component").select(
        F.col("node").alias(ROW), "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("b"))
    member = written(member.join(heads.select(ROW, "copies"), ROW), "members")
    # Every member meets every block of its group: as often as the group has blocks.
    dealt = signed.select(ROW, "size", "sig", "packed").join(member.hint("shuffle_hash"), ROW).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        "component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
        F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"),
        ROW, "copies", "size", "sig", "packed",
    )
    found = dealt.groupBy("component", "i", "j").applyInArrow(_verify(threshold, tolerance), f"{ROW} long, tied long, links long")
    found = written(found, "links")
    links = found.groupBy(ROW).agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("tied").alias("u"), F.col(ROW).alias("v")))

    # Back from sets to rows.
    sets = sets.join(classes.select(F.col("node").alias("set_row"), "component"), "set_row", "left").join(
        links.select(F.col(ROW).alias("set_row"), "links"), "set_row", "left")
    sets = written(sets, "classes")
    rows = signed.select(ROW, "digest").join(sets, "digest", "left")
    return rows.select(
        ROW, F.coalesce("component", "set_row", ROW).alias("class"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))


def _numbered_classes(signed: DataFrame, id_column: str, threshold: float, tolerance: float, block: int) -> DataFrame:
    rows = _classes(signed, threshold, tolerance, block).join(signed.select(ROW, F.col("_in")[id_column].alias("doc_id")), ROW)
    rows = written(rows, "rows")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    return rows.join(written(first, "first"), "class").select(
        ROW, "doc_id", F.col("first.doc_id").alias("class_id"), F.col(f"first.{ROW}").alias("class_row"), "n_links")


def _name(df: DataFrame, column: str) -> str:
    return f"c{df.columns.index(column)}"


def near_copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``class_id`` (the first id of its class of near copies) and ``n_links``.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard similarity
    of at least ``threshold``.
    """
    found = _numbered_classes(_signed(df, text), _name(df, doc_id), threshold, tolerance, block)
    return found.select("doc_id", "class_id", "n_links")


def _restore(names: list[str], text: str):
    def run(batches):
        for batch in batches:
            inside = batch.column("_in")
            fields = iter(inside.flatten())
            arrays = [pa.array([_unpack(x) for x in batch.column("packed").to_pylist()], pa.string()) if n == text else next(fields) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def drop_near_copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """The rows of ``df`` without those that repeat, nearly or fully, the first of their class."""
    signed = _signed(df, text)
    found = _numbered_classes(signed, _name(df, doc_id), threshold, tolerance, block)
    first = written(found.where(F.col(ROW) == F.col("class_row")).select(ROW), "kept")
    kept = signed.select(ROW, "_in", "packed").join(first.hint("shuffle_hash"), ROW).select("_in", "packed")
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return kept.mapInArrow(_restore(df.columns, text), schema)

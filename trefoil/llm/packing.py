"""Best-fit packing of token pieces into sequences of one length, by linear grouping.

Only the histogram of piece lengths, at most one count per possible length, is
planned with. Large lengths are cut into groups of equal cardinality and rounded
up to the largest of their group, which leaves a problem of few sizes. Its
configurations are optimised by column generation: a basis of configurations, the
prices it implies, and a knapsack over the capacity that finds a better
configuration until there is none. Whole multiples of the configurations are then
filled with actual lengths, and what is left, small pieces last, goes best-fit
into the tightest sequence that has room.

The plan says: pieces of this length, from this rank on, so many a sequence, go to
these sequences at this offset. Ranks within a length come from a distributed
sort, and each task looks its pieces up in the plan, whose size depends on the
capacity and not on the data.

Defined cases: a null text is empty and gives one piece, its end id; a longer
document is cut into full pieces and a rest; repeated rows and null ids are packed
like any other; an empty table gives no sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import global_rank
from .common import ROW, written
from .tokens import encoder

CAPACITY = 2048
GROUPS = 32


def _pieces(path: str, spaces: str, end_id: int, capacity: int, with_ids: bool, special: bool):
    def run(batches):
        for batch in batches:
            enc = encoder(path, spaces, special)
            docs, rows, texts = (batch.column(k).to_pylist() for k in range(3))
            for i in range(0, len(texts), 256):
                out = defaultdict(list)
                for doc, row, ids in zip(docs[i : i + 256], rows[i : i + 256], enc.batch([t or "" for t in texts[i : i + 256]])):
                    ids = np.append(np.frombuffer(ids, enc.dtype).astype("<u4"), np.uint32(end_id))
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        for name, v in (("doc_id", doc), (ROW, row), ("piece", k), ("start", start), ("length", len(raw) // 4), ("ids_crc32", zlib.crc32(raw))):
                            out[name].append(v)
                        if with_ids:
                            out["ids"].append(raw)
                arrays = [pa.array(v, pa.binary() if n == "ids" else pa.int32() if n == "piece" else pa.int64()) for n, v in out.items()]
                if arrays:
                    yield pa.RecordBatch.from_arrays(arrays, list(out))
    return run


def pieces(
    df: DataFrame, tokenizer: str, spaces: str, end_id: int, capacity: int = CAPACITY,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, special: bool = False,
) -> DataFrame:
    """Pieces of all documents, written once: ``doc_id``, row, ``piece``, ``start``, ``length``, ``ids_crc32``
    and, if wanted, ``ids`` (little-endian 32-bit numbers)."""
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias(ROW), F.col(text).alias("text"))
    schema = f"doc_id long, {ROW} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return written(source.mapInArrow(_pieces(tokenizer, spaces, end_id, capacity, with_ids, special), schema), "pieces")


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the prices sum highest within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        fits = np.nonzero(sizes <= room)[0]
        value = best[room - sizes[fits]] + prices[fits]
        k = int(value.argmax())
        best[room], choice[room] = best[room - 1], -1
        if value[k] > best[room] + 1e-12:
            best[room], choice[room] = value[k], fits[k]
    taken, room = np.zeros(len(sizes)), capacity
    while room >= smallest:
        if choice[room] < 0:
            room -= 1
        else:
            taken[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return taken


def optimal_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and (fractional) multiples that meet the demand with fewest bins."""
    basis = np.diag(capacity // sizes).astype(float)
    amount = np.linalg.solve(basis, demand)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_configuration(sizes, prices, capacity)
        if column @ prices <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        amount = np.maximum(amount - ratio[leaves] * step, 0)
        basis[:, leaves], amount[leaves] = column, ratio[leaves]
    return [(basis[:, j].round().astype(int), amount[j]) for j in range(len(sizes))]


def _substitute(slots: list[int], there: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """Actual lengths for the rounded sizes of a configuration, largest slot first.

    Each slot takes the largest length there is that leaves the later slots their
    rounded room, so the last one fills what rounding up had left open.
    """
    kind: dict[int, int] = {}
    room, later = capacity, sum(slots)
    for size in slots:
        later -= size
        at = bisect.bisect_right(there, room - later) - 1
        while at >= 0 and left[there[at]] <= kind.get(there[at], 0):
            at -= 1
        if at < 0:
            continue
        l = there[at]
        kind[l] = kind.get(l, 0) + 1
        room -= l
    return kind


def _configured(left: dict[int, int], capacity: int, groups: int) -> list[tuple[list[int], int]]:
    """Configurations of rounded sizes (as slots, largest first) with whole multiples; linear grouping."""
    large = sorted((l for l in left if capacity // 16 < l < capacity), reverse=True)
    total = sum(left[l] for l in large)
    if not total:
        return []
    # Groups of equal cardinality; a length that spans a border belongs to the group it begins in.
    members: dict[int, list[int]] = defaultdict(list)
    seen = 0
    for l in large:
        members[seen * groups // total].append(l)
        seen += left[l]
    sizes = np.array([m[0] for m in members.values()])
    demand = np.array([float(sum(left[l] for l in m)) for m in members.values()])
    found = optimal_configurations(sizes, demand, capacity)
    return [([int(x) for x, c in zip(sizes, config) for _ in range(c)], int(amount + 1e-6)) for config, amount in found]


def _fill(left: dict[int, int], configured, capacity: int, tolerance: int) -> list[tuple[dict[int, int], int]]:
    """Kinds of sequences for all pieces; a configured sequence may leave ``tolerance`` open, else best-fit takes its pieces."""
    left = dict(left)
    bins: dict[int, list] = defaultdict(list)  # by room: (kind, number of sequences)
    there = sorted(l for l in left if capacity // 16 < l < capacity)
    for slots, times in configured:
        while times > 0:
            kind = _substitute(slots, there, left, capacity)
            room = capacity - sum(l * c for l, c in kind.items())
            if not kind or room > tolerance:
                break
            n = min(times, min(left[l] // c for l, c in kind.items()))
            for l, c in kind.items():
                left[l] -= n * c
                if not left[l]:
                    there.remove(l)
            bins[room].append((kind, n))
            times -= n
    rooms = sorted(bins)
    for l in sorted(left, reverse=True):
        n = left[l]
        while n > 0:
            at = bisect.bisect_left(rooms, l)
            if at == len(rooms):
                kind, many, room = {}, -(-n // (capacity // l)), capacity
            else:
                room = rooms[at]
                kind, many = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            each = room // l
            full = min(many, n // each)
            parts = [(each, full)] if full else []
            n -= full * each
            if full < many and n > 0:
                parts.append((n, 1))
                full, n = full + 1, 0
            if full < many and kind:
                parts.append((0, many - full))
            for copies, count in parts:
                new = kind | {l: kind.get(l, 0) + copies} if copies else kind
                new_room = room - copies * l
                if new_room not in bins:
                    bisect.insort(rooms, new_room)
                bins[new_room].append((new, count))
    return [x for room in sorted(bins) for x in bins[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[dict[int, int], int]]:
    """Kinds of sequences: how many pieces of each length one holds, and how many sequences are of the kind.

    Rounding up leaves room open. How much of it a configured sequence may keep
    is tried at several levels, and the plan with the fewest sequences stands.
    """
    left = {int(l): int(n) for l, n in histogram.items() if n > 0}
    if any(l < 1 or l > capacity for l in left):
        raise ValueError("lengths lie between 1 and the capacity")
    configured = _configured(left, capacity, groups)
    plans = [_fill(left, configured, capacity, t) for t in (0, capacity // 512, capacity // 64, capacity)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _lookup(kinds) -> tuple[np.ndarray, ...]:
    """Plan as sorted arrays: (length, first rank) keys, copies a sequence, first sequence, first offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for kind, n in kinds:
        offset = 0
        for l, c in sorted(kind.items(), reverse=True):
            rows.append((l, used[l], c, sequence, offset))
            used[l] += c * n
            offset += c * l
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def _assign(lookup, names: list[str], before: dict[int, int]):
    lengths, firsts, copies, sequences, offsets = lookup
    keys = (lengths << 44) + firsts
    shift = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
    for l, n in before.items():
        shift[l] = n

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) - 1 - shift[length]
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            k = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequences[at] + k // copies[at]), pa.array(offsets[at] + k % copies[at] * length)],
                [*names, "sequence_id", "offset"],
            )
    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` (from ``pieces``)."""
    # At most ``capacity`` rows, one per length.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, seen = {}, 0
    for l in sorted(histogram):
        before[l], seen = seen, seen + histogram[l]
    names = [c for c in cut.columns if c != ROW]
    ranked = global_rank(cut, "length", "doc_id", ROW, "piece", name="_rank").select(*names, "_rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.select(*names).dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(_lookup(plan(histogram, capacity, groups)), names, before), schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves, from packed pieces that hold ``ids``: ``sequence_id``, ``ids`` and their number.

    A group is one sequence, so it never holds more than ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_tokens", F.octet_length("ids") / 4)

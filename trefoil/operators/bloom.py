"""Bloom filters of property columns as a table, built and probed on Spark.

A filter belongs to one (prop, side). Its bits are stored as
``(prop, side, chunk, words)``: chunk c holds 64-bit words 4096c .. 4096c+4095.
All bits of a value lie in one chunk, which a hash of its own picks. So a filter
of any size is probed by an equi-join on the chunk, and a small one, broadcast
whole, passes exactly the same rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import materialise
from .graph import Graph
from .statistics import stats_of_values, value_counts

CHUNK_WORDS = 4096
CHUNK_BITS = 64 * CHUNK_WORDS

# Largest total size of the filters that one join may broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


@dataclass
class Blooms:
    """``meta``: (prop, side, n, m), one row per filter; ``words``: the bits.

    ``sides`` names the filters of a selection made by :meth:`of`.
    """

    fpp: float
    meta: DataFrame
    words: DataFrame
    sides: tuple[tuple[str, str], ...] = ()
    _bits: dict = field(default_factory=dict)

    @property
    def hashes(self) -> int:
        """Bits set per value. At the best size it depends on the rate alone."""
        return max(1, round(-math.log2(self.fpp)))

    def of(self, *sides: tuple[str, str]) -> "Blooms":
        """Only the filters of the given (prop, side) pairs."""
        wanted = reduce(
            Column.__or__, [(F.col("prop") == p) & (F.col("side") == s) for p, s in sides]
        )
        return Blooms(self.fpp, self.meta.where(wanted), self.words.where(wanted), sides, self._bits)

    def bits(self, side: tuple[str, str]) -> int:
        """Size of one filter of the selection, 0 if there is none; looked up once."""
        if any(s not in self._bits for s in self.sides):
            self._bits.update(dict.fromkeys(self.sides, 0))
            self._bits.update({(r["prop"], r["side"]): r["m"] for r in self.meta.collect()})
        return self._bits[side]

    def n_bytes(self) -> int:
        """Total size of the filters."""
        if self.sides:
            return sum(self.bits(side) for side in self.sides) // 8
        return (self.meta.agg(F.sum("m").alias("bits")).first()["bits"] or 0) // 8


def bit_positions(value: Column, m: Column, hashes: int) -> list[Column]:
    """Positions of a value: the start of its chunk, and one seeded hash per bit inside it.

    A filter smaller than a chunk is a single, shorter one. Seeded hashes are
    cheaper here than double hashing, whose sums would have to be kept from
    overflowing and whose generated code is too long to be compiled.
    """
    start = chunk_of(value, m) * CHUNK_BITS
    return [start + F.pmod(F.xxhash64(value, F.lit(i)), F.least(m, F.lit(CHUNK_BITS))) for i in range(hashes)]


def chunk_of(value: Column, m: Column) -> Column:
    """The chunk that holds all bits of a value, in a filter of ``m`` bits."""
    return F.pmod(F.xxhash64(value, F.lit(-1)), F.ceil(m / CHUNK_BITS).cast("long"))


def in_chunk(value: Column, hashes: int, m: Column, words: str = "words") -> Column:
    """Whether a value passes, given the words of its own chunk in a column.

    The bits are tested in a loop. Spelled out, the tests of two or three filters
    make one generated method above 8 kB, which the JVM never compiles.
    """
    size = F.least(m, F.lit(CHUNK_BITS))
    places = F.array(*[F.pmod(F.xxhash64(value, F.lit(i)), size) for i in range(hashes)])

    def bit(place):
        word = F.get(F.col(words), F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.forall(places, bit)


def filter_bits(n: Column, fpp: float) -> Column:
    """Filter size for ``n`` distinct values: -n ln(fpp) / ln(2)^2, at least 64, above a chunk in whole chunks."""
    bits = F.greatest(F.lit(64), F.ceil(n * (-math.log(fpp) / math.log(2) ** 2))).cast("long")
    return F.when(bits > CHUNK_BITS, F.ceil(bits / CHUNK_BITS).cast("long") * CHUNK_BITS).otherwise(bits)


def build_blooms(g: Graph, fpp: float = 0.01, props=None) -> Blooms:
    """Filters for both columns of every property (or of ``props``).

    Each is sized by the distinct count of its own column. Positions come from
    the distinct values, stored or counted, and words are combined on the map
    side, so neither hot values nor copies reach one task.
    """
    distinct = g.distinct if g.distinct is not None else materialise(value_counts(g), "values")
    stats = g.stats if g.stats is not None else stats_of_values(distinct)
    if props is not None:
        stats = stats.where(F.col("prop").isin(list(props)))
        distinct = distinct.where(F.col("prop").isin(list(props)))
    sides = F.inline(F.array(
        F.struct(F.lit("sub").alias("side"), F.col("n_sub").alias("n")),
        F.struct(F.lit("obj").alias("side"), F.col("n_obj").alias("n")),
    ))
    meta = materialise(
        stats.select("prop", sides).withColumn("m", filter_bits(F.col("n"), fpp)), "bloom-meta"
    )
    blooms = Blooms(fpp, meta, None)

    # A value crosses the shuffle once and is made bits behind it: a chunk holds a bounded number of values, and its
    # bits meet where they are made. A row without a value stands for all words of a chunk, also those without a
    # bit, so that an array index is a word number.
    key = ["prop", "side", "chunk"]
    last = ((F.col("m") - 1) / (64 * CHUNK_WORDS)).cast("long")
    empty = meta.select("prop", "side", "m", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).select(
        *key, "m", F.lit(None).cast("string").alias("value"), F.lit(True).alias("empty"))
    values = distinct.select("prop", "side", "value").join(meta, ["prop", "side"]).select(
        *key[:2], chunk_of(F.col("value"), F.col("m")).alias("chunk"), "m", "value", F.lit(False).alias("empty"))
    place = lambda i: F.pmod(F.xxhash64("value", F.lit(i)), F.least("m", F.lit(CHUNK_BITS)))
    places = F.when(F.col("empty"), F.sequence(F.lit(0).cast("long"), F.lit(CHUNK_BITS - 64).cast("long"), F.lit(64).cast("long")))
    places = places.otherwise(F.array(*[place(i) for i in range(blooms.hashes)]))
    bits = values.unionByName(empty).repartition(*key).select(*key, "empty", F.explode(places).alias("pos")).select(
        *key, F.shiftright("pos", 6).cast("int").alias("slot"),
        F.when(F.col("empty"), F.lit(0).cast("long")).otherwise(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"),
    )
    words = bits.groupBy(*key, "slot").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy("prop", "side", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("slot", "bits")))["bits"].alias("words")
    )
    blooms.words = materialise(chunks, "bloom-words")
    return blooms


def save_blooms(blooms: Blooms, path: str) -> None:
    meta = blooms.meta.withColumn("fpp", F.lit(blooms.fpp))
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    blooms.words.write.mode("overwrite").partitionBy("prop", "side").parquet(f"{path}/words")


def load_blooms(spark: SparkSession, path: str) -> Blooms:
    meta = spark.read.parquet(f"{path}/meta")
    schema = "chunk long, words array<long>, prop string, side string"
    words = spark.read.schema(schema).parquet(f"{path}/words")
    first = meta.first()
    return Blooms(first["fpp"] if first else 0.01, meta.drop("fpp"), words)


def graph_blooms(g: Graph, fpp: float = 0.01) -> Blooms:
    """The graph's filters, built on first use."""
    if g.blooms is None:
        g.blooms = build_blooms(g, fpp)
    return g.blooms


def fits(blooms: Blooms, limit: int = BROADCAST_BYTES) -> bool:
    return blooms.n_bytes() <= limit


def bloom_filter_rows(df: DataFrame, column: str, blooms: Blooms, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose value may be in *all* filters of a selection (``blooms.of(...)``).

    Each value meets the one chunk that holds its bits, by an equi-join; up to
    ``limit`` bytes in all the chunks are broadcast, so that the table is filtered
    where it lies. The same rows pass either way. A property that does not exist
    has no filter and lets nothing pass.
    """
    if not blooms.sides:
        raise ValueError("select the filters with of()")
    small = fits(blooms, limit)
    for side in blooms.sides:
        m = blooms.bits(side)
        if m == 0:
            return df.where(F.lit(False))
        parts = blooms.of(side).words.select(F.col("chunk").alias("_chunk"), F.col("words").alias("_words"))
        size = F.lit(m).cast("long")
        keyed = df.withColumn("_chunk", chunk_of(F.col(column), size))
        passes = (keyed["_chunk"] == parts["_chunk"]) & in_chunk(keyed[column], blooms.hashes, size, "_words")
        df = keyed.join(F.broadcast(parts) if small else parts, passes, "left_semi").drop("_chunk")
    return df

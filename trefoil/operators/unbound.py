"""Patterns whose property is a variable: which properties can answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .bloom import CHUNK_WORDS, bit_positions, chunk_of, graph_blooms, in_chunk
from ..sources.shared import materialise
from .graph import Graph
from .pattern import Pattern, bind, is_var, of_properties


def intersect_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("prop").intersect(b.select("prop"))


def candidate_properties(g: Graph, s: str | None = None, o: str | None = None, mode: str = "exact") -> DataFrame:
    """``(prop)``: properties in which all given constants (may) occur.

    Exact mode reads the triples, each constant on its own side, and intersects
    the sets; Bloom mode reads the filters only. An empty set on one side leaves
    an empty answer.
    """
    sets = []
    for side, value in (("sub", s), ("obj", o)):
        if value is None:
            continue
        if mode == "bloom":
            sets.append(_constant_in_filters(g, side, value))
        else:
            sets.append(g.triples.where(F.col(side) == value).select("prop").distinct())
    if not sets:
        return g.triples.select("prop").distinct()
    return sets[0] if len(sets) == 1 else intersect_candidates(*sets)


def _constant_in_filters(g: Graph, side: str, value: str) -> DataFrame:
    """Properties whose filter of one side has all bits of a constant set.

    A few positions per filter meet only the chunks that hold them.
    """
    blooms = graph_blooms(g)
    positions = F.array(*bit_positions(F.lit(value), F.col("m"), blooms.hashes))
    wanted = blooms.meta.where(F.col("side") == side).select("prop", F.explode(F.array_distinct(positions)).alias("pos"))
    wanted = wanted.withColumn("chunk", (F.shiftright("pos", 6) / CHUNK_WORDS).cast("long"))
    word = F.get("words", F.pmod(F.shiftright("pos", 6), F.lit(CHUNK_WORDS)).cast("int"))
    is_set = F.getbit(word, F.col("pos").bitwiseAND(F.lit(63)).cast("int"))
    chunks = blooms.words.where(F.col("side") == side).select("prop", "chunk", "words")
    return (
        wanted.join(chunks, ["prop", "chunk"])
        .groupBy("prop")
        .agg(F.min(is_set).alias("hit"))
        .where(F.col("hit") == 1)
        .select("prop")
    )


def candidate_properties_by_join(
    g: Graph, values: DataFrame, side: str, mode: str = "exact"
) -> DataFrame:
    """``(prop)``: properties whose ``side`` column (may) hold any of the values.

    ``values`` is a one-column table. Exact mode is a semi-join of the triples
    with the distinct values; Bloom mode meets each value with the one chunk of
    each property's filter that could hold it, by an equi-join. The driver sees
    one size per filter.
    """
    wanted = values.toDF(side).distinct()
    if mode == "bloom":
        blooms = graph_blooms(g)
        sizes = [(r["prop"], r["m"]) for r in blooms.meta.where(F.col("side") == side).collect()]
        if not sizes:
            return g.spark.createDataFrame([], "prop string")
        filters = F.explode(F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(m).cast("long").alias("_m")) for p, m in sizes]))
        asked = wanted.select(F.col(side).alias("_value"), filters.alias("_f")).select("_value", "_f.*")
        asked = asked.withColumn("chunk", chunk_of(F.col("_value"), F.col("_m")))
        chunks = blooms.words.where(F.col("side") == side).select("prop", "chunk", "words")
        found = asked.join(chunks, ["prop", "chunk"])
        return found.where(in_chunk(F.col("_value"), blooms.hashes, F.col("_m"))).select("prop").distinct()
    # Written, the values leave both sides as bare shuffles, and a hot value of the triples is divided.
    wanted = materialise(wanted, "values")
    if g.distinct is not None:
        # Stored distinct values hold a hot one once for each property.
        stored = g.distinct.where(F.col("side") == side).select("prop", F.col("value").alias(side))
        return stored.join(wanted, side, "left_semi").select("prop").distinct()
    return g.triples.select("prop", side).join(wanted, side, "left_semi").select("prop").distinct()


def verified_properties(g: Graph, s: str, o: str, candidates: DataFrame) -> DataFrame:
    """``(prop, n)``: candidates that really have matching rows, and how many."""
    return bind(of_properties(g, candidates), (s, "?prop", o)).groupBy("prop").agg(F.count(F.lit(1)).alias("n"))


def candidates_for(g: Graph, patterns: list[Pattern], i: int, mode: str) -> DataFrame | None:
    """Candidate properties of the unbound pattern i inside a query.

    Constants of the pattern are looked up; each bound pattern that shares a
    variable contributes the properties that hold its values on the side where
    the variable stands in pattern i. All sets are intersected; None means that
    nothing restricts the property.
    """
    s, p, o = patterns[i]
    sets = []
    constants = {k: t for k, t in (("s", s), ("o", o)) if not is_var(t)}
    if constants:
        sets.append(candidate_properties(g, mode=mode, **constants))
    for side, term in (("sub", s), ("obj", o)):
        if not is_var(term) or term == p:
            continue
        for j, (qs, q, qo) in enumerate(patterns):
            if j == i or is_var(q) or term not in (qs, qo):
                continue
            values = bind(g.prop(q), (qs, q, qo)).select(term[1:])
            sets.append(candidate_properties_by_join(g, values, side, mode))
    if not sets:
        return None
    allowed = sets[0]
    for other in sets[1:]:
        allowed = intersect_candidates(allowed, other)
    return allowed

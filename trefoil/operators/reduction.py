"""Semi-join reductions: property tables shrunk by the columns they join with."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.signatures import signature_parts, signature_text
from ..sources.shared import exists
from .bloom import BROADCAST_BYTES, bloom_filter_rows, graph_blooms
from .graph import Graph
from .pattern import Pattern, is_var

Side = tuple[str, str]
SIDES = ("sub", "obj")


def partner_sides(patterns: list[Pattern], i: int) -> dict[str, list[Side]]:
    """Columns that pattern i joins with, for each of its two sides.

    Only patterns with a constant property count; the pattern's own position
    does not, other uses of the same property do.
    """
    s, p, o = patterns[i]
    found: dict[str, list[Side]] = {}
    if is_var(p):
        return found
    for side, term in zip(SIDES, (s, o)):
        if not is_var(term):
            continue
        partners = {
            (q, other_side)
            for j, (qs, q, qo) in enumerate(patterns)
            if not is_var(q)
            for other_side, other in zip(SIDES, (qs, qo))
            if other == term and (j, other_side) != (i, side)
        }
        if partners:
            found[side] = sorted(partners)
    return found


def semi_join(df: DataFrame, side: str, g: Graph, partner: Side) -> DataFrame:
    """Exact reduction of one column by one partner column.

    The partner's distinct values are written once per graph; both sides of the
    join are then bare shuffles, and adaptive execution divides a hot value on
    the reduced side.
    """
    prop, partner_side = partner
    values = g.values(prop, partner_side).select(F.col(partner_side).alias(side))
    return df.join(values, side, "left_semi").select(*df.columns)


def reduce_property(
    g: Graph,
    p: str,
    side: str,
    partners,
    mode: str = "exact",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Property table filtered on ``side`` by all partner columns.

    ``side`` is "sub", "obj" or "both"; for "both", ``partners`` is a dict from
    side to (prop, side) pairs, otherwise a list of pairs. ``mode="bloom"`` tests
    the partners' Bloom filters, broadcast up to ``limit`` bytes and joined by
    chunk beyond; the rows are the same.
    """
    by_side = partners if side == "both" else {side: partners}
    rows = g.prop(p)
    for column, sides in by_side.items():
        if mode == "bloom":
            rows = bloom_filter_rows(rows, column, graph_blooms(g).of(*sides), limit)
        elif mode == "exact":
            for partner in sides:
                rows = semi_join(rows, column, g, partner)
        else:
            raise ValueError(f"unknown reduction mode {mode!r}")
    return rows


class Reductions:
    """Reductions kept across queries, one per property and join signature.

    ``side="both"`` (default) reduces a property on all its join columns,
    ``side="one"`` on the subject if it joins there, else on the object.
    """

    def __init__(self, g: Graph, mode: str = "exact", side: str = "both", keep: bool = True):
        self.g, self.mode, self.side, self.keep = g, mode, side, keep
        self._kept: dict[str, DataFrame] = {}

    def signatures(self, patterns: list[Pattern], i: int) -> dict[str, str]:
        """Signature text per reduced side of pattern i."""
        prop = patterns[i][1]
        texts = {
            side: signature_text((prop, side), partners)
            for side, partners in partner_sides(patterns, i).items()
        }
        if self.side == "one" and len(texts) == 2:
            del texts["obj"]
        return texts

    def key(self, patterns: list[Pattern], i: int) -> str:
        return " ".join(self.signatures(patterns, i).values())

    def is_kept(self, patterns: list[Pattern], i: int) -> bool:
        return self.key(patterns, i) in self._kept

    def table(self, patterns: list[Pattern], i: int) -> DataFrame:
        """``(sub, obj)`` of pattern i's property, reduced; kept for later queries."""
        prop = patterns[i][1]
        key = self.key(patterns, i)
        if not key:
            return self.g.prop(prop)
        if key not in self._kept:
            partners = {side: signature_parts(text)[1:] for side, text in self.signatures(patterns, i).items()}
            rows = reduce_property(self.g, prop, "both", partners, self.mode)
            self._kept[key] = rows.persist(StorageLevel.MEMORY_AND_DISK) if self.keep else rows
        return self._kept[key]

    def release(self) -> None:
        for rows in self._kept.values():
            rows.unpersist()
        self._kept.clear()


def reduction_report(g: Graph, patterns: list[Pattern], reductions: Reductions | None = None) -> DataFrame:
    """``(pos, prop, n_before, n_after, ratio)`` per pattern with a constant property.

    One job: a union of counts.
    """
    reductions = reductions or Reductions(g, keep=False)
    parts = []
    for i, (_, p, _) in enumerate(patterns):
        if is_var(p):
            continue
        for name, rows in (("n_before", g.prop(p)), ("n_after", reductions.table(patterns, i))):
            count = rows.agg(F.count(F.lit(1)).alias("n"))
            parts.append(count.select(F.lit(i).alias("pos"), F.lit(p).alias("prop"), F.lit(name).alias("what"), "n"))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    before, after = [F.max(F.when(F.col("what") == w, F.col("n"))) for w in ("n_before", "n_after")]
    report = counts.groupBy("pos", "prop").agg(before.alias("n_before"), after.alias("n_after"))
    ratio = F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).otherwise(F.lit(1.0))
    return report.withColumn("ratio", ratio)


# --- reductions stored as marker columns -------------------------------------------------


def marked_property(g: Graph, p: str, signatures, mode: str = "exact") -> DataFrame:
    """Property table with one nullable column per signature.

    The column holds 1 where the row belongs to that reduction, else null. Each
    distinct partner column is joined once, whatever the number of signatures.
    """
    parsed = {text: signature_parts(text) for text in signatures}
    rows = g.prop(p)
    needed = sorted({(parts[0][1], partner) for parts in parsed.values() for partner in parts[1:]})
    flags: dict[tuple[str, Side], str] = {}
    for i, (side, partner) in enumerate(needed):
        flag = flags[side, partner] = f"_in{i}"
        prop, partner_side = partner
        values = g.values(prop, partner_side).select(F.col(partner_side).alias(side))
        if mode == "bloom":
            values = bloom_filter_rows(rows.select(side).distinct(), side, graph_blooms(g).of(partner))
        rows = rows.join(values.withColumn(flag, F.lit(1)), side, "left")
    columns = []
    for text, parts in parsed.items():
        tests = [F.col(flags[parts[0][1], partner]) for partner in parts[1:]]
        # greatest() skips nulls, so membership is the conjunction spelled out.
        member = tests[0].isNotNull()
        for test in tests[1:]:
            member = member & test.isNotNull()
        columns.append(F.when(member, F.lit(1)).alias(text))
    return rows.select("sub", "obj", *columns)


def materialize_reductions(g: Graph, signatures, path: str, mode: str = "exact") -> DataFrame:
    """Write marked property tables below ``path``; returns ``(prop, signature, n)``.

    One folder per property named by a signature's head. The counts are stored
    beside the tables for :func:`best_reduction`.
    """
    by_prop: dict[str, list[str]] = {}
    for text in dict.fromkeys(signatures):
        by_prop.setdefault(signature_parts(text)[0][0], []).append(text)
    stats = None
    for prop, texts in by_prop.items():
        marked_property(g, prop, texts, mode).write.mode("overwrite").parquet(_marked_path(path, prop))
        stored = g.spark.read.parquet(_marked_path(path, prop))
        counts = stored.agg(*[F.count(F.col(f"`{t}`")).alias(t) for t in texts])
        long = counts.select(F.lit(prop).alias("prop"), F.inline(F.array(*[
            F.struct(F.lit(t).alias("signature"), F.col(f"`{t}`").alias("n")) for t in texts
        ])))
        stats = long if stats is None else stats.unionByName(long)
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    return g.spark.read.parquet(f"{path}/stats")


def _marked_path(path: str, prop: str) -> str:
    # As a partition folder the name may hold any character.
    from urllib.parse import quote

    return f"{path}/tables/{quote(prop, safe='')}"


def reduced(g: Graph, path: str, p: str, signature: str | None) -> DataFrame:
    """``(sub, obj)`` rows of a stored reduction.

    Without a usable marker column the whole property table is returned.
    """
    if not exists(g.spark, _marked_path(path, p)):
        return g.prop(p)
    table = g.spark.read.parquet(_marked_path(path, p))
    if signature is not None and signature in table.columns:
        table = table.where(F.col(f"`{signature}`").isNotNull())
    return table.select("sub", "obj")


class StoredReductions:
    """Reductions written by :func:`materialize_reductions`, for ``bgp(reductions=...)``.

    A pattern reads the smallest stored column whose partners all join with it
    in the query, else its whole property table. The driver holds one row per
    stored signature.
    """

    def __init__(self, g: Graph, path: str):
        self.g, self.path = g, path
        self._stored: dict[str, list[tuple[int, str]]] = {}
        for r in g.spark.read.parquet(f"{path}/stats").collect():
            self._stored.setdefault(r["prop"], []).append((r["n"], r["signature"]))

    def choice(self, patterns: list[Pattern], i: int) -> str | None:
        """Signature that pattern i reads."""
        joined = partner_sides(patterns, i)
        usable = []
        for n, text in self._stored.get(patterns[i][1], []):
            (_, side), *partners = signature_parts(text)
            if set(partners) <= set(joined.get(side, [])):
                usable.append((n, text))
        return min(usable)[1] if usable else None

    def table(self, patterns: list[Pattern], i: int) -> DataFrame:
        return reduced(self.g, self.path, patterns[i][1], self.choice(patterns, i))


def best_reduction(stats: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(prop, signature, n)``: the smallest non-empty reduction per property.

    ``candidates`` is an optional ``(prop, signature)`` table of usable ones.
    """
    usable = stats.where(F.col("n") > 0)
    if candidates is not None:
        usable = usable.join(candidates.select("prop", "signature").distinct(), ["prop", "signature"], "left_semi")
    smallest = F.min(F.struct("n", "signature")).alias("best")
    return usable.groupBy("prop").agg(smallest).select("prop", "best.signature", "best.n")

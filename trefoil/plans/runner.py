"""Running a workload and recording what each query cost."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from ..operators.bgp import bgp, bgp_count
from ..operators.graph import Graph
from ..operators.pattern import is_var
from ..operators.reduction import Reductions
from ..sources.runs import RUN_SCHEMA
from .texts import LoggedQuery


def max_join_degree(patterns) -> int:
    """Largest number of positions, on bound properties, that share a variable."""
    uses = Counter(t for s, p, o in patterns if not is_var(p) for t in (s, o) if is_var(t))
    return max(uses.values(), default=0)


def _sizes(g: Graph, reductions: Reductions, patterns) -> int:
    """Rows of all reduced tables of one query, counted in a single job."""
    parts = [
        reductions.table(patterns, i).agg(F.count(F.lit(1)).alias("n"))
        for i, (_, p, _) in enumerate(patterns)
        if not is_var(p)
    ]
    if not parts:
        return 0
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.agg(F.sum("n").alias("n")).first()["n"]


def answer_count(g: Graph, query: LoggedQuery, **options) -> DataFrame:
    """One row ``(n)``: how many answers a query has, with its filters and DISTINCT."""
    if query.distinct:
        rows = bgp(g, query.patterns, query.select, True, query.filters, **options)
        return rows.agg(F.count(F.lit(1)).alias("n"))
    return bgp_count(g, query.patterns, query.filters, **options)


def run_workload(g: Graph, queries, reductions: Reductions | None = None) -> DataFrame:
    """Run table (one row per query) of ``(name, patterns)`` pairs or logged queries, in that order.

    Every query is one count over reduced tables. A query is warm if all the
    reductions it needs were kept from earlier queries (and it needs any).
    """
    kept = reductions or Reductions(g)
    records = []
    for query in queries:
        if not isinstance(query, LoggedQuery):
            query = LoggedQuery(*query, select=[])
        name, patterns = query.name, [tuple(p) for p in query.patterns]
        start = time.perf_counter()
        bound = [i for i, (_, p, _) in enumerate(patterns) if not is_var(p)]
        needed = [i for i in bound if kept.key(patterns, i)]
        is_warm = bool(needed) and all(kept.is_kept(patterns, i) for i in needed)
        sizes = g.sizes([patterns[i][1] for i in bound])
        reduction_sizes = _sizes(g, kept, patterns)
        n = answer_count(g, query._replace(patterns=patterns), stats=sizes, reductions=kept, allow_cross=True).first()["n"]
        records.append((
            str(name), n, (time.perf_counter() - start) * 1000, sum(sizes[patterns[i][1]][0] for i in bound),
            reduction_sizes, max_join_degree(patterns), is_warm, len(patterns),
        ))
    if reductions is None:
        kept.release()
    return g.spark.createDataFrame(records, RUN_SCHEMA)

"""Conjunctive graph patterns (lists of triple patterns) as DataFrames.

Answers are bags: duplicate triples count. Three forms of answer:

* :func:`bgp` - rows of bindings,
* :func:`bgp_grouped` - distinct bindings of chosen variables with multiplicity,
* :func:`bgp_count` - the number of bindings.

The last two never produce the rows they count. A variable that is not needed
any more is summed away before the join that would multiply it, so a value
that many subjects share costs as much as its rows, not as their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..plans.order import join_order
from .division import Division
from .graph import Graph
from .numbering import repeat_rows
from .pattern import Pattern, bind, is_var, pattern, var_name, variables
from .reduction import Reductions
from .unbound import candidates_for

Filter = tuple[str, str, str]
# Internal columns; variables are words and do not begin with an underscore.
_W = "_weight"
_N = "_number"


def _tables(g: Graph, patterns, reductions, candidates) -> list[DataFrame]:
    """Bindings of every pattern, in list order."""
    if isinstance(reductions, str):
        reductions = Reductions(g, mode=reductions, keep=False)
    tables = []
    for i, (s, p, o) in enumerate(patterns):
        if is_var(p):
            allowed = candidates_for(g, patterns, i, candidates) if candidates else None
            tables.append(pattern(g, s, p, o, allowed))
        elif reductions is not None:
            tables.append(bind(reductions.table(patterns, i), (s, p, o)))
        else:
            tables.append(pattern(g, s, p, o))
    return tables


def _sizes(g: Graph, patterns, stats) -> dict | None:
    """Sizes of the properties named in the query, a few numbers per pattern."""
    named = [p for _, p, _ in patterns if not is_var(p)]
    if stats is None and g.stats is not None:
        return g.sizes(named)
    if isinstance(stats, DataFrame):
        return Graph(g.triples, stats).sizes(named)
    return stats


def _all_variables(patterns) -> list[str]:
    return list(dict.fromkeys(v for p in patterns for v in variables(p)))


def _split_filters(patterns, filters):
    """Filters as (a, b) variable pairs and (a, constant) pairs."""
    known = set(_all_variables(patterns))
    pairs, constants = [], []
    for a, op, b in filters:
        if op != "!=":
            raise ValueError(f"unsupported filter operator {op!r}")
        if not is_var(a):
            a, b = b, a
        for v in (a, b):
            if is_var(v) and var_name(v) not in known:
                raise ValueError(f"filter on unknown variable {v}")
        if is_var(b):
            pairs.append((var_name(a), var_name(b)))
        else:
            constants.append((var_name(a), b))
    return pairs, constants


def _apply_local(table: DataFrame, vars_, pairs, constants) -> DataFrame:
    """Filters that concern the variables of one table only."""
    for a, value in constants:
        if a in vars_:
            table = table.where(F.col(a) != value)
    for a, b in pairs:
        if a in vars_ and b in vars_:
            table = table.where(F.col(a) != F.col(b))
    return table


def bgp(
    g: Graph,
    patterns: Sequence[Pattern],
    select: Sequence[str] | None = None,
    distinct: bool = False,
    filters: Sequence[Filter] = (),
    allow_cross: bool = False,
    stats=None,
    reductions: Reductions | str | None = None,
    candidates: str | None = None,
) -> DataFrame:
    """Bindings that satisfy all patterns, one column per selected variable.

    ``select`` lists variables (default: all, in order of appearance),
    ``filters`` holds ``("?a", "!=", "?b")`` triples. Patterns without a shared
    variable need ``allow_cross``. ``stats`` orders the joins (a dict of
    sizes or a property statistics table; stored statistics are used by themselves),
    ``reductions`` ("exact", "bloom" or a :class:`Reductions`) evaluates over
    reduced tables, ``candidates`` ("exact" or "bloom") prunes free properties.
    """
    patterns = [tuple(p) for p in patterns]
    names = [var_name(v) for v in select] if select is not None else _all_variables(patterns)
    if distinct:
        grouped = bgp_grouped(
            g, patterns, [f"?{n}" for n in names], filters, allow_cross, stats, reductions, candidates, count_as=_N
        )
        return grouped.drop(_N)

    pairs, constants = _split_filters(patterns, filters)
    tables = _tables(g, patterns, reductions, candidates)
    rows, bound, factors, done = None, set(), [], []
    division = Division(g)
    for i in join_order(patterns, _sizes(g, patterns, stats)):
        vars_ = variables(patterns[i])
        if not vars_:
            factors.append(tables[i].agg(F.count(F.lit(1)).alias("n")))
            continue
        table = _apply_local(tables[i], vars_, pairs, constants)
        shared = [v for v in vars_ if v in bound]
        if rows is None:
            rows = table
        elif shared:
            rows = division.join(rows, table, shared, done, patterns[i])
        elif allow_cross:
            rows = rows.crossJoin(table)
        else:
            raise ValueError(f"pattern {patterns[i]} shares no variable; pass allow_cross=True")
        done.append(patterns[i])
        before, bound = bound, bound | set(vars_)
        for a, b in pairs:
            if {a, b} <= bound and not {a, b} <= before and not {a, b} <= set(vars_):
                rows = rows.where(F.col(a) != F.col(b))
    if rows is None:
        rows = g.spark.range(1).select()
    rows = rows.select(*names)
    for n in factors:
        # A pattern without variables repeats every row by its number of matches.
        rows = repeat_rows(rows.withColumn(_W, n.scalar()), _W)
    return rows


def _connected(patterns) -> list[list[int]]:
    """Positions grouped into sets that share variables; no group without any."""
    groups: list[tuple[set[str], list[int]]] = []
    for i, p in enumerate(patterns):
        vars_ = set(variables(p))
        if not vars_:
            continue
        touching = [grp for grp in groups if grp[0] & vars_]
        groups = [grp for grp in groups if not grp[0] & vars_]
        merged = (vars_.union(*[t[0] for t in touching]), sorted([i, *[j for t in touching for j in t[1]]]))
        groups.append(merged)
    return [members for _, members in groups]


def _sum_weights(rows: DataFrame, keys) -> DataFrame:
    weight = F.sum(_W) if _W in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*keys).agg(weight.alias(_W))


def _weighted(g: Graph, tables, patterns, order, by) -> DataFrame:
    """``by`` columns and a weight for one connected group of patterns.

    Weights of a heavy value are summed by (value, salt) on the side that has its
    rows; the summed side is copied for every salt, and the last sum merges them.
    """
    rows, division = None, Division(g)
    for step, i in enumerate(order):
        table = tables[i]
        later = set(by).union(*[variables(patterns[j]) for j in order[step + 1:]])
        vars_ = variables(patterns[i])
        bound = [] if rows is None else [c for c in rows.columns if c != _W and c not in division.extra(rows.columns)]
        keys = [v for v in vars_ if v in bound]
        keep = [v for v in vars_ if v in keys or v in later]
        fans_out = set(keep) - set(keys)
        if rows is None:
            rows = table
            continue
        summed = len(keep) < len(vars_) or not fans_out
        if summed:
            table = _sum_weights(table, keep).withColumnRenamed(_W, "_right")
        needed = [v for v in bound if v in keys or v in later]
        merged = False
        if len(needed) < len(bound):
            # Before a join that multiplies rows, merge those that differ only in dropped variables.
            salted = division.extra(rows.columns)
            kept = [*needed, *[c for c in salted if c in map(division.column, needed)]]
            merged = bool(fans_out) and kept == keys
            rows = _sum_weights(rows, kept) if fans_out else rows.select(*kept, *[c for c in rows.columns if c == _W])
        # A table summed by its one key has a row for each value; a wider one may still hold a heavy value often.
        rows = division.join(rows, table, keys, [patterns[j] for j in order[:step]], patterns[i], summed and len(keep) == 1, merged)
        if "_right" in rows.columns:
            product = F.col("_right") * F.col(_W) if _W in rows.columns else F.col("_right")
            rows = rows.withColumn(_W, product).drop("_right")
    return _sum_weights(rows, by)


def _summing_order(patterns, order, by) -> list[int]:
    """``order`` rearranged so that as few variables as can be wait to be summed away.

    For graphs without statistics. Two open variables that are not grouped by
    are a list of pairs; a pattern that closes one goes before one that opens
    another. Every pattern still shares a variable with an earlier one if it can.
    """
    left, done, seen = list(order), [], set()

    def waiting(i):
        later = set().union(*[variables(patterns[j]) for j in left if j != i])
        return len((seen | set(variables(patterns[i]))) & later - set(by))

    while left:
        joined = [i for i in left if seen & set(variables(patterns[i]))]
        chosen = min(joined, key=waiting) if joined else left[0]
        left.remove(chosen)
        done.append(chosen)
        seen |= set(variables(patterns[chosen]))
    return done


def _grouped_unfiltered(g, tables, patterns, sizes, by, allow_cross) -> DataFrame:
    order = join_order(patterns, sizes)
    if sizes is None:
        order = _summing_order(patterns, order, by)
    groups = _connected(patterns)
    if len(groups) > 1 and not allow_cross:
        raise ValueError("patterns share no variable; pass allow_cross=True")
    factors = [tables[i].agg(F.count(F.lit(1)).alias(_W)) for i, p in enumerate(patterns) if not variables(p)]
    answer = None
    for members in groups:
        vars_ = {v for i in members for v in variables(patterns[i])}
        part = _weighted(g, tables, patterns, [i for i in order if i in members], [v for v in by if v in vars_])
        if len(part.columns) == 1:
            factors.append(part)
        elif answer is None:
            answer = part
        else:
            both = answer.withColumnRenamed(_W, "_left").crossJoin(part)
            answer = both.withColumn(_W, F.col("_left") * F.col(_W)).drop("_left")
    if answer is None:
        answer, *factors = factors
        answer = answer.select(F.coalesce(_W, F.lit(0)).cast("long").alias(_W))
    for factor in factors:
        answer = answer.withColumn(_W, F.col(_W) * F.coalesce(factor.scalar(), F.lit(0).cast("long")))
    return answer.select(*by, F.col(_W).alias(_N))


def bgp_grouped(
    g: Graph,
    patterns: Sequence[Pattern],
    by: Sequence[str],
    filters: Sequence[Filter] = (),
    allow_cross: bool = False,
    stats=None,
    reductions: Reductions | str | None = None,
    candidates: str | None = None,
    count_as: str = "n",
) -> DataFrame:
    """Distinct bindings of ``by`` with ``n``, the number of bindings of all variables.

    ``count_as`` names the count where ``n`` is a variable.

    A filter between variables that are not both grouped by is counted by
    inclusion and exclusion: bindings with ``?a != ?b`` are all bindings less
    those of the same patterns with one variable in place of the two. So pairs
    are never listed to compare their ends.
    """
    patterns = [tuple(p) for p in patterns]
    names = [var_name(v) for v in by]
    if count_as in names:
        raise ValueError(f"?{count_as} is grouped by; choose another name with count_as")
    pairs, constants = _split_filters(patterns, filters)
    direct = [p for p in pairs if set(p) <= set(names)]
    local = [p for p in pairs if any(set(p) <= set(variables(q)) for q in patterns)]
    excluded = [p for p in pairs if p not in direct and p not in local]

    tables = _tables(g, patterns, reductions, candidates)
    tables = [_apply_local(t, set(variables(p)), local, constants) for t, p in zip(tables, patterns)]
    sizes = _sizes(g, patterns, stats)

    signed = []
    for size in range(len(excluded) + 1):
        for chosen in combinations(excluded, size):
            merged, merged_tables, kept = _merge_variables(patterns, tables, chosen, names)
            columns = list(dict.fromkeys(kept[n] for n in names))
            part = _grouped_unfiltered(g, merged_tables, merged, sizes, columns, allow_cross)
            part = part.select(*[F.col(kept[n]).alias(n) for n in names], (F.col(_N) * (-1) ** size).alias(_N))
            signed.append(part)
    answer = signed[0]
    if len(signed) > 1:
        for part in signed[1:]:
            answer = answer.unionByName(part)
        answer = answer.groupBy(*names).agg(F.sum(_N).alias(_N))
    for a, b in direct:
        answer = answer.where(F.col(a) != F.col(b))
    if names:
        answer = answer.where(F.col(_N) > 0)
    return answer.withColumnRenamed(_N, count_as)


def _merge_variables(patterns, tables, equal, preferred):
    """Patterns and tables after setting the variable pairs ``equal``."""
    kept = {v: v for v in _all_variables(patterns)}
    for a, b in equal:
        a, b = kept[a], kept[b]
        if a not in preferred:
            a, b = b, a
        kept = {v: a if k == b else k for v, k in kept.items()}
    merged, merged_tables = [], []
    for p, table in zip(patterns, tables):
        vars_ = variables(p)
        merged.append(tuple(f"?{kept[var_name(t)]}" if is_var(t) else t for t in p))
        first: dict[str, str] = {}
        for v in vars_:
            if kept[v] in first:
                table = table.where(F.col(v) == F.col(first[kept[v]]))
            else:
                first[kept[v]] = v
        merged_tables.append(table.select(*[F.col(v).alias(k) for k, v in first.items()]))
    return merged, merged_tables, kept


def bgp_count(g: Graph, patterns: Sequence[Pattern], filters: Sequence[Filter] = (), **options) -> DataFrame:
    """One row ``(n)``: the number of bindings, as a bag."""
    return bgp_grouped(g, patterns, [], filters, **options)

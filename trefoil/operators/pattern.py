"""One triple pattern as a table of variable bindings.

A pattern is ``(s, p, o)``; a position that starts with ``?`` is a variable,
anything else a constant. Bindings have one column per variable, named without
the ``?``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import materialise
from .graph import Graph

# Most property names that a filter lists.
LISTED = 1000

Pattern = tuple[str, str, str]


def is_var(term: str) -> bool:
    return term.startswith("?")


def var_name(term: str) -> str:
    return term[1:]


def variables(pattern: Pattern) -> list[str]:
    """Variable names of a pattern, each once, in s-p-o order."""
    return list(dict.fromkeys(var_name(t) for t in pattern if is_var(t)))


def bind(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of a pattern over ``(sub, prop, obj)`` or ``(sub, obj)`` rows.

    Constants become filters, a repeated variable an equality, and the columns
    left are renamed to the variables.
    """
    ends = list(zip(("sub", "prop", "obj"), pattern))
    if "prop" not in rows.columns:
        ends = [ends[0], ends[2]]
    first: dict[str, str] = {}
    for column, term in ends:
        if not is_var(term):
            rows = rows.where(F.col(column) == term)
        elif term in first:
            rows = rows.where(F.col(column) == F.col(first[term]))
        else:
            first[term] = column
    return rows.select(*[F.col(c).alias(var_name(t)) for t, c in first.items()])


def pattern(g: Graph, s: str, p: str, o: str, candidates: DataFrame | None = None) -> DataFrame:
    """Bindings of one pattern, all eight constant/variable combinations.

    ``candidates`` is an optional ``(prop)`` table for a free property, see
    :func:`of_properties`.
    """
    if not is_var(p):
        return bind(g.prop(p), (s, p, o))
    rows = g.triples
    if candidates is not None:
        rows = of_properties(g, candidates)
    return bind(rows.select("sub", "prop", "obj"), (s, p, o))


def of_properties(g: Graph, candidates: DataFrame, limit: int = LISTED) -> DataFrame:
    """Triples whose property is in a ``(prop)`` table, without moving triples by property.

    The names are found first and written. Up to ``limit`` of them become a filter
    on the property, which a stored graph answers with its folders alone. More
    stay a table of known size, which Spark sends to the tasks below its threshold
    and then prunes folders by. The rows are the same either way.
    """
    names = materialise(candidates.select("prop").distinct(), "candidates")
    few = [r["prop"] for r in names.limit(limit + 1).collect()]
    if len(few) <= limit:
        return g.triples.where(F.col("prop").isin(few))
    # Spark prunes folders at run time only by a table that has a filter; this one keeps every name.
    return g.triples.join(names.where(F.col("prop") >= ""), "prop", "left_semi").select("sub", "prop", "obj")

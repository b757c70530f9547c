"""Column expressions over RDF terms (IRIs, literals, variables).

A stored term is a plain string: an IRI in its short form (``gr__offers``), a
literal that keeps its quotes and any language tag or datatype, or (in query
patterns only) a variable starting with ``?``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Prefixes = Sequence[tuple[str, str]]


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_variable(c: Column | str) -> Column:
    return as_column(c).startswith("?")


def is_literal(c: Column | str) -> Column:
    """Plain, language-tagged and typed literals all begin with a quote."""
    return as_column(c).startswith('"')


def is_iri(c: Column | str) -> Column:
    return ~is_literal(c) & ~is_variable(c)


def _in_brackets(c: Column) -> Column:
    return c.startswith("<") & c.endswith(">")


# Length argument of substr() for "up to the end".
_REST = 2**31 - 1


def _after(c: Column, n: int) -> Column:
    return c.substr(n + 1, _REST)


def strip_brackets(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(_in_brackets(c), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def shorten(c: Column | str, prefixes: Prefixes) -> Column:
    """Replace the leading namespace of a term without ``<>`` by ``short__``.

    One flat CASE with two plain string operations per namespace, longest
    first, so that the generated code of a whole prefix list stays small enough
    to be compiled.
    """
    c = as_column(c)
    cases = F.when(is_literal(c), c)
    for name, namespace in sorted(prefixes, key=lambda p: -len(p[1])):
        cases = cases.when(c.startswith(namespace), F.concat(F.lit(f"{name}__"), _after(c, len(namespace))))
    return cases.otherwise(c)


def compress_iri(c: Column | str, prefixes: Prefixes) -> Column:
    """Drop ``<>`` and shorten a leading namespace to ``short__``.

    Namespaces are anchored at the start, so one that begins with another one
    wins over it. Literals pass unchanged. Readers of large inputs do the two
    steps in two selects, to compute the bare term once.
    """
    return shorten(strip_brackets(c), prefixes)


def expand_iri(c: Column | str, prefixes: Prefixes, brackets: bool = False) -> Column:
    """Inverse of :func:`compress_iri`; unknown short names stay as they are."""
    c = as_column(c)
    left, right = (F.lit("<"), F.lit(">")) if brackets else (F.lit(""), F.lit(""))
    cases = F.when(is_literal(c) | is_variable(c), c)
    for name, namespace in prefixes:
        head = f"{name}__"
        cases = cases.when(
            c.startswith(head), F.concat(left, F.lit(namespace), _after(c, len(head)), right)
        )
    return cases.otherwise(F.concat(left, c, right))


def resolve_iri(c: Column | str, base: str) -> Column:
    """Put ``base`` before a relative IRI, written with or without ``<>``."""
    c = as_column(c)
    return (
        F.when(c.contains("://") | is_literal(c) | is_variable(c), c)
        .when(_in_brackets(c), F.concat(F.lit(f"<{base}"), _after(c, 1)))
        .otherwise(F.concat(F.lit(base), c))
    )

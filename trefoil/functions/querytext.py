"""Column expressions over query names, ids and texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .terms import as_column

# Markers used in the names of published query and result files.
NAME_MARKER = "__VP_SO-OS-SS-VP"
TIME_MARKER = " [SO-OS-SS-VP__"

# The three texts of queries with a free property.
UNBOUND_TEXTS = {
    "sUo": "SELECT ?predicate WHERE { %s ?predicate %s }",
    "UUo": "SELECT ?subject ?predicate WHERE { ?subject ?predicate %s }",
    "sUU": "SELECT ?predicate ?object WHERE { %s ?predicate ?object }",
}


def query_class(c: Column | str) -> Column:
    """Queries 1-100 form class 1, 101-200 class 2, and so on."""
    return (F.floor((as_column(c) - 1) / 100) + 1).cast("long")


def query_variables(c: Column | str) -> Column:
    """Distinct variables of a query text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(as_column(c), F.lit(r"(\?\w+)"), 1))


def expand_star(c: Column | str) -> Column:
    """Replace ``*`` in a query text by its variables."""
    c = as_column(c)
    return F.replace(c, F.lit("*"), F.array_join(query_variables(c), " "))


def unbound_query_text(sub: Column | str, obj: Column | str, kind: str) -> Column:
    """Query text with a free property and the constant ends named by ``kind``."""
    ends = {"sUo": [sub, obj], "UUo": [obj], "sUU": [sub]}[kind]
    return F.format_string(UNBOUND_TEXTS[kind], *[as_column(e) for e in ends])


def query_name(c: Column | str) -> Column:
    """Name part of a query file name: up to the first dot and the marker."""
    return F.substring_index(F.substring_index(as_column(c), ".", 1), NAME_MARKER, 1)

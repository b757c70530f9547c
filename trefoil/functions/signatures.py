"""Text form of a reduction: ``<prop>_TRPS_JOIN_<prop>_TRPO_JOIN_...``.

The head names the property and the side that is reduced, the partners (in
sorted order) name the columns it is reduced by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .terms import as_column

# Side tags and separator of the published signature format.
SIDE_TAGS = {"sub": "_TRPS", "obj": "_TRPO"}
JOIN = "_JOIN_"

_LABEL = re.compile(r"^(.*)_TRP([SO])$")


def label(prop: Column | str, side: str) -> Column:
    return F.concat(as_column(prop), F.lit(SIDE_TAGS[side]))


def signature(head: Column | str, partners: Column | str) -> Column:
    """``head`` is a label, ``partners`` an array of labels in any order."""
    return F.concat_ws(JOIN, as_column(head), F.array_sort(as_column(partners)))


def split_signature(c: Column | str) -> Column:
    """Array of ``struct(prop, side)``, head first."""
    return F.transform(
        F.split(as_column(c), JOIN),
        lambda part: F.struct(
            F.regexp_extract(part, _LABEL.pattern, 1).alias("prop"),
            F.when(part.endswith(SIDE_TAGS["sub"]), F.lit("sub")).otherwise(F.lit("obj")).alias("side"),
        ),
    )


def signature_text(head: tuple[str, str], partners) -> str:
    """The same text for one (prop, side) head and its partners, as a string."""
    labels = sorted(p + SIDE_TAGS[s] for p, s in set(partners))
    return JOIN.join([head[0] + SIDE_TAGS[head[1]], *labels])


def signature_parts(text: str) -> list[tuple[str, str]]:
    """(prop, side) pairs of one signature string, head first."""
    parts = []
    for piece in text.split(JOIN):
        found = _LABEL.match(piece)
        if not found:
            raise ValueError(f"not a signature: {text!r}")
        parts.append((found.group(1), "sub" if found.group(2) == "S" else "obj"))
    return parts

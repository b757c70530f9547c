"""Reading triple text, and the property-partitioned Parquet store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.terms import Prefixes, is_literal, shorten, strip_brackets

SCHEMA = "sub string, prop string, obj string"
_ENDS = ["sub", "prop", "obj"]
STORED = "sub string, obj string, prop string"


_BLANK = " \t\r"


def _without_dot(fields: DataFrame) -> DataFrame:
    """``obj`` without the closing dot of its line and the blanks around it.

    Each select reads plain columns of the one before, so that no string is
    cut twice.
    """
    obj = F.col("obj")
    trimmed = fields.select("sub", "prop", F.rtrim("obj", F.lit(_BLANK)).alias("obj"))
    cut = F.rtrim(obj.substr(F.lit(1), F.length("obj") - 1), F.lit(_BLANK))
    return trimmed.select("sub", "prop", F.when(obj.endswith("."), cut).otherwise(obj).alias("obj"))


def parse_triples(lines: DataFrame, sep: str = " ", prefixes: Prefixes = ()) -> DataFrame:
    """Triples from a ``value`` column of ``sub<sep>prop<sep>obj .`` lines.

    The closing dot is optional; further separators belong to the object, where
    they come back as single spaces. Lines that begin with ``#`` are comments.
    """
    # split() takes a pattern; blanks need no quoting and are split faster without.
    quoted = sep if sep in (" ", "\t") else rf"\Q{sep}\E"
    part = F.col("part")
    parts = lines.where(~F.col("value").startswith("#")).select(F.split("value", quoted, 3).alias("part"))
    parts = parts.where((F.size(part) == 3) & ~F.trim(part[2]).isin("", "."))
    fields = _without_dot(parts.select(part[0].alias("sub"), part[1].alias("prop"), part[2].alias("obj")))
    if sep != " ":
        spaced = F.when(F.col("obj").contains(sep), F.replace("obj", F.lit(sep), F.lit(" "))).otherwise(F.col("obj"))
        fields = fields.select("sub", "prop", spaced.alias("obj"))
    bare = fields.select(*[strip_brackets(c).alias(c) for c in _ENDS])
    return bare.select(*[shorten(c, prefixes).alias(c) for c in _ENDS])


def read_triples(spark: SparkSession, path, sep: str = " ", prefixes: Prefixes = ()) -> DataFrame:
    return parse_triples(spark.read.text(path), sep, prefixes)


def clean_triples(lines: DataFrame, prefixes: Prefixes, base: str) -> DataFrame:
    """Triples from a tab-separated dump (``value`` column) with relative IRIs.

    Comment (``#``) and directive (``@``) lines go, known namespaces become
    short names, relative ``<x>`` gets the short name ``base``, ``a:b`` becomes
    ``a__b`` (inside a typed literal only its datatype does), and only lines of
    exactly three parts stay.
    """
    value, part = F.col("value"), F.col("part")
    kept = lines.where(~value.startswith("#") & ~value.startswith("@"))
    parts = kept.select(F.split(F.ltrim("value"), "\t", 5).alias("part"))
    # A dot may follow the third part after a tab.
    dot_only = (F.size(part) == 4) & F.trim(F.get(part, 3)).isin("", ".")
    parts = parts.where((F.size(part) == 3) | dot_only)
    fields = _without_dot(parts.select(part[0].alias("sub"), part[1].alias("prop"), part[2].alias("obj")))

    def bare(name):
        term = F.col(name)
        bracketed = term.startswith("<") & term.endswith(">")
        datatype = F.regexp_replace(term, r"\^\^([^<>:\s]+):([^<>:\s]+)$", "^^$1__$2")
        return (
            F.when(bracketed & ~term.contains("://"), F.concat(F.lit(f"{base}__"), strip_brackets(term)))
            .when(bracketed, strip_brackets(term))
            .when(is_literal(term), F.when(term.contains("^^"), datatype).otherwise(term))
            .when(term.contains(":"), F.regexp_replace(term, r"^([^:]*):([^:]*)$", "$1__$2"))
            .otherwise(term)
        )

    terms = fields.select(*[bare(c).alias(c) for c in _ENDS])
    return terms.select(*[shorten(c, prefixes).alias(c) for c in _ENDS])


def write_vp(triples: DataFrame, path: str, partitions: int | None = None) -> None:
    """One write of all property tables, ``path/prop=<p>/``.

    Rows are range-partitioned by (prop, sub, obj) and sorted, so a property
    that holds a third of the graph is spread over many tasks and files, a rare
    one gets a single small file, and row-group statistics on ``sub`` prune
    lookups by subject. The map partition as last key divides even the copies
    of one triple.
    """
    keys = ["prop", "sub", "obj"]
    salted = triples.select("sub", "obj", "prop", F.spark_partition_id().alias("_salt"))
    spread = (
        salted.repartitionByRange(partitions, *keys, "_salt")
        if partitions
        else salted.repartitionByRange(*keys, "_salt")
    )
    spread.sortWithinPartitions(*keys).drop("_salt").write.mode("overwrite").partitionBy("prop").parquet(path)


def read_vp(spark: SparkSession, path: str) -> DataFrame:
    """The stored triples; ``where(prop = ...)`` reads that property's files only."""
    return spark.read.schema(STORED).parquet(path).select("sub", "prop", "obj")



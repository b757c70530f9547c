"""Line deduplication by overlapping windows of three lines.

Every run of three consecutive lines is hashed. A window found more than once in
the whole corpus keeps its first occurrence, in the order of (document id, row,
line); the lines of all later occurrences are removed, where overlapping windows
merge. Windows are judged on the input, not on what is left, and those without a
single word are no windows.

Defined cases: a null text stays null and has no lines; fewer than three lines
never match; rows with a null id come last; of repeated rows the first keeps its
lines. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, let, numbered, written

WINDOW = 3


def _windows(text: Column, window: int) -> Column:
    """Array of (two hashes, place) for the windows of a text."""
    def of(lines):
        hashes = F.transform(lines, lambda l: F.struct(F.xxhash64(l).alias("a"), F.xxhash64(F.lit(1), l).alias("b"), l.rlike("[^ \\t-\\r]").alias("word")))
        return let(hashes, lambda hs: F.filter(
            F.transform(F.sequence(F.lit(1), F.size(hs) - (window - 1)), lambda i: let(F.slice(hs, i, window), lambda w: F.struct(
                F.xxhash64(w["a"]).alias("a"), F.xxhash64(F.lit(1), w["b"]).alias("b"), (i - 1).alias("pos"),
                F.exists(w, lambda x: x["word"]).alias("word"),
            ))), lambda w: w["word"],
        ))
    nothing = F.array().cast("array<struct<a:bigint,b:bigint,pos:int,word:boolean>>")
    return let(F.split(text, "\n"), lambda lines: F.when(F.size(lines) >= window, of(lines)).otherwise(nothing))


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with the text that is left, and a struct column ``lines`` (``n_lines``, ``n_removed``)."""
    # The text is held once; the other columns go beside it under names of their own.
    inner = {c: f"c{k}" for k, c in enumerate(df.columns) if c != text}
    docs = numbered(df, *[df[c].alias(n) for c, n in inner.items()], F.col(text).alias("_text"))
    key = F.coalesce(F.col(inner[doc_id]).cast("long"), F.lit(2**63 - 1)).alias("key")
    found = docs.select(key, ROW, F.explode(_windows(F.col("_text"), window)).alias("w")).select("key", ROW, "w.a", "w.b", "w.pos")
    place = F.struct("key", ROW, "pos")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Read back, both sides of the join are plain scans and a very common window can be divided.
    first = written(first.select("a", "b", "first"), "windows")
    later = found.join(first, ["a", "b"]).where(place != F.col("first"))
    removed = later.groupBy(ROW).agg(F.collect_list("pos").alias("at"))
    joined = docs.join(removed.hint("shuffle_hash"), ROW, "left")

    def left_over(lines):
        gone = F.array_distinct(F.flatten(F.transform("at", lambda p: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: p + k))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_removed"),
        )

    whole = F.struct(
        F.col("_text").alias("text"), F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_removed"),
    )
    out = joined.select(*inner.values(), F.when(F.col("at").isNull(), whole).otherwise(let(F.split("_text", "\n"), left_over)).alias("o"))
    return out.select(
        *[F.col("o.text" if c == text else inner[c]).alias(c) for c in df.columns],
        F.struct("o.n_lines", "o.n_removed").alias("lines"),
    )

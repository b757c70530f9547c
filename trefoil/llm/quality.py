"""Quality rules as a cascade ordered by rejections per cost.

A document first meets two base rules (too few words, too much repetition), then
a list of further rules. A ``CASE`` tries them one after the other and stops at
the first that rejects; their order comes from a bounded sample, on which each
rule's share of rejected documents and its running time are measured. The order
changes the work and never the verdict.

Defined cases: a null or empty text has no words and fails the base. Repeated
rows are judged one by one, all columns of the input are kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, text_of

# White space that separates words, and the same as a set of characters.
SPACE = "[ \\t-\\r]+"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
_INDEX_BITS = 24
SAMPLE_SHARE = 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``reject`` holds; may use the text (``text``) and the base columns."""

    name: str
    reject: Column


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of words found twice or more in the text.

    Window hashes that are all different end the matter. Otherwise hash and
    place are packed into one number and sorted, so that equal windows become
    neighbours, and neighbours are compared word by word.
    """
    low = F.lit((1 << _INDEX_BITS) - 1).cast("long")

    def same(packed, k):
        a, b = F.get(packed, k), F.get(packed, k + 1)
        return F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS)

    def starts(packed, ws):
        place = lambda k: F.get(packed, k).bitwiseAND(low)
        at = lambda k: F.slice(ws, place(k).cast("int") + 1, window)
        pairs = F.filter(
            F.sequence(F.lit(0), F.size(packed) - 2), lambda k: same(packed, k) & (at(k) == at(k + 1))
        )
        return F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda k: F.array(place(k), place(k + 1))))))

    def covered(st):
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(st) - 1),
            lambda k: F.least(F.lit(window).cast("long"), F.coalesce(F.get(st, k + 1) - F.get(st, k), F.lit(window).cast("long"))),
        )
        return F.when(F.size(st) > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))

    def pack(hashes):
        return F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, _INDEX_BITS), _INDEX_BITS).bitwiseOR(i.cast("long"))))

    def of(ws):
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window)))
        return F.when(F.size(ws) <= window, F.lit(0).cast("long")).otherwise(
            let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
                let(let(pack(hs), lambda p: starts(p, ws)), covered)))
        )

    return let(words, of)


def base_columns(text: Column) -> Column:
    """Struct of the base counts of a text."""
    def counts(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(
                F.filter(F.split(text, "\n"), lambda l: l.rlike("[^ \\t-\\r]")),
                lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
            ).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )
    return let(words_of(text), counts)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules for prose; every bound is a share of the words or characters, so it holds at any length."""
    text = F.col("text")
    n = F.col("n_words")
    upper = F.regexp_count(text, F.lit("\\p{Lu}"))
    lower = F.regexp_count(text, F.lit("\\p{Ll}"))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("dup_lines", 2 * F.col("n_dup_lines") > F.regexp_count(text, F.lit("\n")) + 1),
        Rule("exclamations", 5 * F.regexp_count(text, F.lit("!")) > n),
        Rule("capitals", upper > 2 * lower),
        Rule("digits", 2 * F.regexp_count(text, F.lit("[0-9]")) > F.col("word_chars")),
    ]


def order_rules(counted: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second of work, estimated on a sample with ``text`` and the base columns.

    The sample is held in memory while every rule runs over it twice, the second
    time against the clock.
    """
    sample = counted.cache()
    total = sample.count()
    if not total:
        sample.unpersist()
        return list(rules)
    shares = sample.agg(*[F.count(F.when(r.reject, 1)).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    costs = []
    for rule in rules:
        spent = []
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count(F.when(rule.reject, 1))).collect()
            spent.append(time.perf_counter() - start)
        costs.append(min(spent))
    sample.unpersist()
    # A rule that rejects nothing in the sample still has a chance: one row in twice the sample.
    gain = [max(n, 0.5) / total / cost for n, cost in zip(shares, costs)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def verdict(rules: list[Rule]) -> Column:
    """True where neither the base nor any rule rejects; stops at the first that does."""
    chain = F.when(base_failed(), False)
    for rule in rules:
        chain = chain.when(F.coalesce(rule.reject, F.lit(False)), False)
    return chain.otherwise(True)


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Add one struct column ``quality`` with the base counts, ``base_failed`` and ``kept``."""
    rules = default_rules() if rules is None else rules
    inner = text_of(text).alias("text")
    # The sample is bounded before anything is computed on it.
    sample = df.select(inner).sample(SAMPLE_SHARE, seed=7).limit(sample_rows)
    counted = sample.select("text", base_columns(F.col("text")).alias("b")).select("text", "b.*")
    ordered = order_rules(counted, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = (
        df.select(F.struct(*[df[c] for c in df.columns]).alias("_in"), inner)
        .withColumn("_b", base_columns(F.col("text")))
        .select("_in", "text", "_b.*")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", verdict(ordered))
    )
    return judged.select(*[F.col("_in")[c].alias(c) for c in df.columns], F.struct(*names, "base_failed", "kept").alias("quality"))


def keep_good(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text passes, with the columns of ``df``."""
    return judge(df, text, **options).where("quality.kept").select(*df.columns)

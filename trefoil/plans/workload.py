"""A query log as data.

``workload`` tables have one row per triple pattern: ``(query_id, query_seq,
pos, s, p, o)``; ``pos`` identifies a pattern inside its query and ``query_seq``
is the order of execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.querytext import query_class
from ..functions.signatures import SIDE_TAGS, signature
from ..functions.terms import is_literal, is_variable
from ..sources.shared import materialise

def _ends(workload: DataFrame) -> DataFrame:
    """Long form: ``(query_id, query_seq, var, pos, prop, side)``, variables only."""
    ends = F.inline(F.array(
        F.struct(F.lit("sub").alias("side"), F.col("s").alias("var")),
        F.struct(F.lit("obj").alias("side"), F.col("o").alias("var")),
    ))
    bound = workload.where(~is_variable("p"))
    return (
        bound.select("query_id", "query_seq", "pos", F.col("p").alias("prop"), ends)
        .where(is_variable("var"))
        .select("query_id", "query_seq", "var", "pos", "prop", "side")
    )


def join_variables(workload: DataFrame) -> DataFrame:
    """Variable positions on bound properties: ``(query_id, var, pos, prop, side)``."""
    return _ends(workload).select("query_id", "var", "pos", "prop", "side")


def _tag(side: Column | str) -> Column:
    side = F.col(side) if isinstance(side, str) else side
    return F.when(side == "sub", F.lit(SIDE_TAGS["sub"])).otherwise(F.lit(SIDE_TAGS["obj"]))


def _label_counts(workload: DataFrame) -> DataFrame:
    """Uses of each (prop, side) per query variable; combined on the map side."""
    return _ends(workload).groupBy("query_id", "query_seq", "var", "prop", "side").agg(F.count(F.lit(1)).alias("uses"))


def join_pairs(workload: DataFrame) -> DataFrame:
    """``(prop_a, side_a, prop_b, side_b, n)``: position pairs sharing a variable.

    Each unordered pair of positions counts once, with the smaller (prop, side)
    first. Positions are counted per (prop, side) before they are paired, so a
    query with many patterns costs its distinct columns, not its position pairs.
    """
    counts = _label_counts(workload)
    key = ["query_id", "var"]
    a = counts.select(*key, F.col("prop").alias("prop_a"), F.col("side").alias("side_a"), F.col("uses").alias("_a"))
    b = counts.select(*key, F.col("prop").alias("prop_b"), F.col("side").alias("side_b"), F.col("uses").alias("_b"))
    first, second = F.struct("prop_a", "side_a"), F.struct("prop_b", "side_b")
    # A column used u times pairs with itself u(u-1)/2 times.
    itself = (F.col("prop_a") == F.col("prop_b")) & (F.col("side_a") == F.col("side_b"))
    pairs = F.when(itself, F.expr("_a * (_a - 1) div 2")).otherwise(F.col("_a") * F.col("_b"))
    columns = ["prop_a", "side_a", "prop_b", "side_b"]
    return (
        a.join(b, key).where(first <= second)
        .select(*columns, pairs.alias("n")).where(F.col("n") > 0)
        .groupBy(*columns).agg(F.sum("n").alias("n"))
    )


def _label_sets(workload: DataFrame) -> DataFrame:
    """Per query variable the array of its labels; as long as its distinct columns."""
    label = F.concat("prop", _tag("side"))
    return (
        _label_counts(workload)
        .select("query_id", "query_seq", "var", F.struct(label.alias("label"), "uses", "prop", "side").alias("l"))
        .groupBy("query_id", "query_seq", "var")
        .agg(F.array_sort(F.collect_list("l")).alias("labels"))
    )


def _own_signatures(workload: DataFrame) -> DataFrame:
    """``(query_id, query_seq, var, prop, side, sig)`` for every joined label.

    A label's partners are the other labels of its variable, and the label
    itself where the variable uses it more than once.
    """
    own = _label_sets(workload).withColumn("own", F.explode("labels"))
    partners = F.filter("labels", lambda x: (x["label"] != F.col("own.label")) | (x["uses"] > 1))["label"]
    return (
        own.withColumn("partners", partners)
        .where(F.size("partners") > 0)
        .select(
            "query_id", "query_seq", "var", "own.prop", "own.side",
            signature("own.label", "partners").alias("sig"),
        )
    )


def reduction_signatures(workload: DataFrame) -> DataFrame:
    """``(query_id, query_seq, pos, side, sig)``: the reduction each position needs."""
    key = ["query_id", "query_seq", "var", "prop", "side"]
    return _ends(workload).join(_own_signatures(workload), key).select("query_id", "query_seq", "pos", "side", "sig")


def candidate_signatures(workload: DataFrame) -> DataFrame:
    """``(prop, signature)``: reductions worth storing, own property first.

    For each join variable: every pair of labels and, for three or more uses,
    the full set. Labels of one variable are few (its distinct columns).
    """
    own = _label_sets(workload).withColumn("own", F.explode("labels"))
    others = F.filter("labels", lambda x: (x["label"] != F.col("own.label")) | (x["uses"] > 1))["label"]
    own = own.select(F.col("own.prop").alias("prop"), F.col("own.label").alias("head"), others.alias("partners"))
    sets = F.concat(F.transform("partners", lambda x: F.array(x)), F.array("partners"))
    return (
        own.where(F.size("partners") > 0)
        .select("prop", "head", F.explode(F.array_distinct(sets)).alias("partners"))
        .select("prop", signature("head", "partners").alias("signature"))
        .distinct()
    )


def warm_cold(workload: DataFrame) -> DataFrame:
    """``(query_id, query_seq, sig, is_warm)``: was the reduction computed before?

    A signature is warm in every query after the first that uses it. First uses
    are aggregated, written and joined back; both sides of that join are plain
    shuffles, so adaptive execution divides a popular signature.
    """
    used = _own_signatures(workload).select("query_id", "query_seq", "sig").distinct()
    used = materialise(used, "signatures")
    first = materialise(used.groupBy("sig").agg(F.min("query_seq").alias("_first")), "first-uses")
    return used.join(first, "sig").select(
        "query_id", "query_seq", "sig", (F.col("_first") < F.col("query_seq")).alias("is_warm")
    )


def query_features(workload: DataFrame) -> DataFrame:
    """``(query_id, num_triples, max_joins)``.

    ``max_joins`` is the largest number of positions that share one variable,
    counted on bound properties.
    """
    # One pass: every pattern gives a row without variable and one per variable end.
    bound = ~is_variable("p")
    uses = F.inline(F.array(
        F.struct(F.lit(True).alias("counted"), F.lit(None).cast("string").alias("var")),
        F.struct((bound & is_variable("s")).alias("counted"), F.col("s").alias("var")),
        F.struct((bound & is_variable("o")).alias("counted"), F.col("o").alias("var")),
    ))
    degrees = (
        workload.select("query_id", uses).where("counted").groupBy("query_id", "var").agg(F.count(F.lit(1)).alias("uses"))
    )
    is_pattern = F.col("var").isNull()
    return degrees.groupBy("query_id").agg(
        F.sum(F.when(is_pattern, F.col("uses"))).alias("num_triples"),
        F.coalesce(F.max(F.when(~is_pattern, F.col("uses"))), F.lit(0).cast("long")).alias("max_joins"),
    )


def workload_sample(
    queries: DataFrame, k: int, min_class: int = 1, exclude=(), order: str = "query_seq"
) -> DataFrame:
    """The first ``k`` queries of every class of query ids (see query_class).

    ``queries`` has ``query_id`` and the ``order`` column. The rank filter lets
    Spark keep only k rows per class and task before anything is shuffled.
    """
    from pyspark.sql import Window

    classed = queries.withColumn("query_class", query_class("query_id")).where(F.col("query_class") >= min_class)
    if exclude:
        classed = classed.where(~F.col("query_class").isin(list(exclude)))
    place = F.row_number().over(Window.partitionBy("query_class").orderBy(order, "query_id"))
    return classed.withColumn("place", place).where(F.col("place") <= k)


def sample_slices(triples: DataFrame, n: int = 2000, size: int = 500, seed: int = 0) -> DataFrame:
    """A random sample of ``n`` triples in disjoint slices of ``size`` rows.

    Every copy of a triple has a digest of its own, made of the seed, the triple and
    the copy's number; the ``n`` smallest are drawn. So a seed fixes the sample, however
    the rows are stored. Each task keeps its ``n`` smallest, and only those meet. Literals
    that do not end in their quote are dropped after drawing. The sample itself is
    numbered in one task; its size is the parameter ``n``.
    """
    from pyspark.sql import Window

    counted = triples.groupBy("sub", "prop", "obj").agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_n - 1) div 65536"))))
    # Two explodes, so that no array is longer than a block, whatever the number of copies.
    last = F.least(F.col("_n"), (F.col("_block") + 1) * 65536)
    numbered = numbered.withColumn("_copy", F.explode(F.sequence(F.col("_block") * 65536 + 1, last)))
    draw = F.md5(F.concat_ws("\x01", F.lit(str(seed)), "sub", "prop", "obj", F.col("_copy").cast("string")))
    drawn = numbered.select("sub", "prop", "obj", draw.alias("_draw")).orderBy("_draw").limit(n)
    kept = drawn.where(~(is_literal("obj") & ~F.col("obj").endswith('"')))
    place = F.row_number().over(Window.orderBy("_draw"))
    return kept.withColumn("slice", F.floor((place - 1) / size).cast("int")).drop("_draw")


def sample_properties(sample: DataFrame) -> DataFrame:
    """``(prop, n)``: the properties that a sample holds, with their rows."""
    return sample.groupBy("prop").agg(F.count(F.lit(1)).alias("n"))


def pattern_lists(workload: DataFrame):
    """Yield ``(query_id, [patterns])`` in order of execution, for running them.

    Queries are executed one after the other from the driver, so their texts
    pass it one by one.
    """
    from itertools import groupby

    rows = workload.orderBy("query_seq", "query_id", "pos").toLocalIterator()
    for query_id, group in groupby(rows, key=lambda r: r["query_id"]):
        yield query_id, [(r["s"], r["p"], r["o"]) for r in group]

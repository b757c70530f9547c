"""Which properties a workload uses together."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from ..functions.terms import is_variable
from ..operators.numbering import global_rank
from ..sources.shared import materialise


def transactions(workload: DataFrame) -> DataFrame:
    """``(query_id, items)``: distinct properties of queries that use two or more."""
    bound = workload.where(~is_variable("p"))
    sets = bound.groupBy("query_id").agg(F.array_sort(F.collect_set("p")).alias("items"))
    return sets.where(F.size("items") >= 2)


def frequent_patterns(workload: DataFrame, min_support: float = 0.08) -> DataFrame:
    """``(items, freq)``: property sets of size above one with enough support."""
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(transactions(workload))
    return model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("items"), "freq")


def similar_properties(workload: DataFrame, prop: str, k: int = 10, min_count: int = 100, seed: int = 0) -> DataFrame:
    """``(word, similarity)``: the k properties nearest to one in a word2vec space.

    Sentences are the property sequences of the queries. Long ones are cut into
    consecutive pieces of ``_SENTENCE`` properties, as the trainer itself would
    cut them, so no sequence is gathered whole.
    """
    return property_vectors(workload, min_count, seed).findSynonyms(prop, k)


_SENTENCE = 1000


def property_vectors(workload: DataFrame, min_count: int = 100, seed: int = 0):
    bound = workload.where(~is_variable("p"))
    # A distributed sort numbers all positions; the first number of a query turns that into places within it.
    ranked = global_rank(bound.select("query_id", "pos", "p"), "query_id", "pos", "p", name="_rank")
    firsts = materialise(ranked.groupBy("query_id").agg(F.min("_rank").alias("_first")), "firsts")
    pieces = ranked.join(firsts, "query_id").withColumn("_piece", F.floor((F.col("_rank") - F.col("_first")) / _SENTENCE))
    sentences = (
        pieces.groupBy("query_id", "_piece")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "p")))["p"].alias("items"))
        .where(F.size("items") >= 2)
    )
    trainer = Word2Vec(
        inputCol="items", outputCol="vector", stepSize=0.05, minCount=min_count, maxSentenceLength=_SENTENCE, seed=seed
    )
    return trainer.fit(sentences.select("items"))

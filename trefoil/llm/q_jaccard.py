"""Registered query of the near-duplicate join."""

from .common import table
from .jaccard import near_copies
from .registry import query


@query("op7_bayes_jaccard_join")
def op7_bayes_jaccard_join(spark, folder):
    return near_copies(table(spark, folder, "documents").select("doc_id", "text"))

"""Registered query of the repeated-string removal."""

from .common import table
from .registry import query
from .substrings import remove_repeats


@query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_kept=False)

"""Registered query of the packing."""

from .common import table
from .packing import pack, pieces
from .registry import query
from .tokens import vocabulary


def packed(docs):
    return pack(pieces(docs, vocabulary("word_bpe_49k.json"), "dropped", end_id=0, special=True))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, folder):
    return packed(table(spark, folder, "documents").select("doc_id", "text"))

"""Registered query of the binary id format."""

from .binary import read_ids, write_ids
from .common import table
from .registry import query
from .tokens import vocabulary


@query("op3_binary_ids")
def op3_binary_ids(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = write_ids(docs, vocabulary("byte_bpe_50k.json"), "leading", end_id=2, special=True)
    return read_ids(spark, path, with_ids=False)

"""Registered query of encoding and decoding."""

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .tokens import vocabulary
from .transducer import MARK, decode, encode


@query("op2_transducer_encoding")
def op2_transducer_encoding(spark, folder):
    """Ids of every text, and whether decoding gives the text back (marks in a text count as spaces)."""
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = decode(encode(docs, path), path)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))

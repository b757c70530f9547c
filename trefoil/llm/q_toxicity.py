"""Registered query of the toxicity scores."""

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .toxicity import fit, toxicity, training_rows


@query("op13_string_kernel_toxicity")
def op13_string_kernel_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(*training_rows(docs, labels, ~held_out))
    return toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")

"""From raw documents to packed training sequences, in five stages.

Each stage gets what the one before kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trefoil.llm.common import written
from trefoil.llm.jaccard import drop_near_copies
from trefoil.llm.lines import line_dedup
from trefoil.llm.pii import redact
from trefoil.llm.q_packing import packed
from trefoil.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality cascade."""
    return keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; ``n_chars`` follows the text.

    A document of which nothing but white space is left is a copy throughout and goes.
    """
    left = line_dedup(docs)
    left = left.where((F.col("lines.n_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return _counted(left.select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 2048."""
    return packed(docs)


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

# Near copies and packing have no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

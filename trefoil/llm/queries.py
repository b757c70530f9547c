"""All registered queries of this folder."""

from . import (  # noqa: F401  (register their queries)
    q_binary, q_jaccard, q_lines, q_merkle, q_negatives, q_neighbours, q_packing, q_pii, q_quality, q_substrings, q_toxicity, q_transducer, q_warc,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

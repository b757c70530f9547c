from .registry import QUERIES, SQL
from . import answers, log, store, terms  # noqa: F401  (register their queries)

__all__ = ["QUERIES", "SQL"]

"""Registered query of the personal-data search."""

from .common import table
from .pii import pii_report
from .registry import query


@query("op10_pii_boosting")
def op10_pii_boosting(spark, folder):
    return pii_report(table(spark, folder, "documents").select("doc_id", "text"))

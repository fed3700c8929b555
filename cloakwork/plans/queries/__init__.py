"""Every operator as a query over the given tables, with the SQL that checks it.

A query is ``(spark, directory) -> DataFrame``; each reads its tables whole and has an SQL text for the same
result on the same tables.
"""

from __future__ import annotations

from . import detection, evaluation, reports, restoring, sources, streams, texts
from .common import KEY, ORACLES, QUERIES

# The flagship query: every document, masked.
FLAGSHIP = "masked_wrapped_documents"

__all__ = [
    "FLAGSHIP",
    "KEY",
    "ORACLES",
    "QUERIES",
    "detection",
    "evaluation",
    "reports",
    "restoring",
    "sources",
    "streams",
    "texts",
]

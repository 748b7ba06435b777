"""All queries of the library's own operators over the driver's tables, with the SQL of each."""

from __future__ import annotations

from . import catalog_queries, conversation_queries, ledger_queries, review_queries, spatial_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "turns"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

"""The named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import event_queries, fundamentals_queries, ml_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (text_queries, vector_queries, event_queries, fundamentals_queries, ml_queries):
    QUERIES |= _part.REGISTRY.queries
    ORACLES |= _part.REGISTRY.oracles

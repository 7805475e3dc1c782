"""Queries over the driver's tables, one per operator of the inventory, and their SQL."""

from __future__ import annotations

from ledgerloom.plans import closure_queries, document_queries, fact_queries, kernel_queries, source_queries

_PARTS = (kernel_queries, fact_queries, document_queries, closure_queries, source_queries)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}

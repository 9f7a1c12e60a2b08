"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from tallystone.plans import claim_queries, ingest_queries, ledger_queries, quality_queries, search_queries, view_queries
from tallystone.plans.claim_queries import flagship

_MODULES = [claim_queries, ingest_queries, ledger_queries, view_queries, search_queries, quality_queries]

QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

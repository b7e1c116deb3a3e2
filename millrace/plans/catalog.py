"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from . import learned_queries, ledger_queries, series_queries, text_queries, vector_queries

MODULES = (text_queries, vector_queries, series_queries, ledger_queries, learned_queries)
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}

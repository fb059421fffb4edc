"""Registered queries of the reference operators and their SQL equivalents."""

from __future__ import annotations

from tracelake.plans import document_queries, package_queries, store_queries, table_queries, text_queries

QUERIES = {f.__name__: f for m in (text_queries, table_queries, document_queries, store_queries, package_queries) for f in m.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **document_queries.ORACLE_SQL, **store_queries.ORACLE_SQL, **package_queries.ORACLE_SQL}

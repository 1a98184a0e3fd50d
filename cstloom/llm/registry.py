"""Queries and SQL of this package."""

from __future__ import annotations

from cstloom.llm import abuse_queries, credential_queries, documentation_queries, near_duplicate_queries, neighbour_queries, oracle, provenance_queries, syntax_queries, token_queries

QUERIES = {**syntax_queries.QUERIES, **credential_queries.QUERIES, **neighbour_queries.QUERIES, **documentation_queries.QUERIES, **near_duplicate_queries.QUERIES, **provenance_queries.QUERIES, **token_queries.QUERIES, **abuse_queries.QUERIES}
ORACLE_SQL: dict[str, str] = oracle.SQL

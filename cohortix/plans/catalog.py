"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from . import matrix_queries, network_queries, source_queries, stat_queries

QUERIES = matrix_queries.QUERIES | stat_queries.QUERIES | network_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = matrix_queries.ORACLE_SQL | stat_queries.ORACLE_SQL | network_queries.ORACLE_SQL | source_queries.ORACLE_SQL

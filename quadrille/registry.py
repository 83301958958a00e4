"""All queries and the SQL that checks them, by name."""

from __future__ import annotations

from quadrille.plans import file_queries, mesh_queries, queries

QUERIES: dict = queries.QUERIES | mesh_queries.QUERIES | file_queries.QUERIES
SQL: dict[str, str] = queries.SQL | mesh_queries.SQL | file_queries.SQL

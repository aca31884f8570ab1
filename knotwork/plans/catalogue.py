"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from knotwork.plans import data_queries, graph_queries, store_queries

QUERIES = {**data_queries.QUERIES, **graph_queries.QUERIES, **store_queries.QUERIES}
SQL = {**data_queries.SQL, **graph_queries.SQL, **store_queries.SQL}

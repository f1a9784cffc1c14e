"""All named queries and their SQL; where a name comes twice, the later module's holds."""

from __future__ import annotations

from flightloom.plans import catalog, dense_queries, image_queries, operator_queries

QUERIES = {**catalog.QUERIES, **operator_queries.QUERIES, **image_queries.QUERIES, **dense_queries.QUERIES}
SQL = {**catalog.SQL, **operator_queries.SQL, **image_queries.SQL, **dense_queries.SQL}

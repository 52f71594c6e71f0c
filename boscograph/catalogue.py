"""All queries of the engine by name, and the SQL they must agree with."""

from __future__ import annotations

from boscograph.plans import documents, graphs, relating, reviews

QUERIES = {**documents.QUERIES, **relating.QUERIES, **graphs.QUERIES, **reviews.QUERIES}
SQL = {**documents.SQL, **relating.SQL, **graphs.SQL, **reviews.SQL}

"""All core queries: importing this module registers every one."""

from __future__ import annotations

from stratlas.plans import (  # noqa: F401
    graph_queries,
    incremental_queries,
    learn_queries,
    planning_queries,
    record_queries,
    relational_queries,
    scoring_queries,
    source_queries,
    text_queries,
    vector_queries,
)
from stratlas.plans.registry import QUERIES, SQL

QUERIES.update(incremental_queries.QUERIES)
SQL.update(incremental_queries.SQL)

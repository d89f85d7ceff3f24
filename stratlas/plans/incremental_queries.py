"""Queries of the incremental operator (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratlas.operators.incremental import replay
from stratlas.session import read


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return replay(read(spark, sf, "repo_fetch"), read(spark, sf, "ingest_run"))


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
with ok as (select run_id, started_at from ingest_run where status = 'ok' and started_at is not null),
s as (select run_id, started_at, repo_id, arg_max({'e': embedding_input, 'r': readme_raw}, (fetched_at, fetch_id)) c
      from ok join repo_fetch on landed_at <= started_at group by all),
l as (select *, lag(c) over w p, row_number() over w k from s window w as (partition by repo_id order by started_at, run_id))
select run_id, repo_id from l where k = 1 or c.e is distinct from p.e or c.r is distinct from p.r
"""
}

"""Every core query against its SQL; those without SQL must run and keep their schema."""

from __future__ import annotations

import pytest

from stratlas.plans.catalogue import QUERIES, SQL
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, data, name):
    agree(spark, duck, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    assert [r.asDict().keys() for r in df.limit(1).collect()] in ([], [dict.fromkeys(df.columns).keys()])


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

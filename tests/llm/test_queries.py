"""Every training-data query against its SQL, or at least run, and all of them on empty and on hostile tables."""

from __future__ import annotations

import os

import pytest

from stratlas.llm import queries, sql
from tests.oracle import agree

ALL, SQL = queries.queries(), sql.oracle_sql()
FOUND = {
    "p1_found": ["origin", "row_id", "seg_no", "lang"], "p2_found": ["repo_id", "cluster_key"], "p3_found": ["repo_a", "repo_b", "higher_id"],
    "p5_found": ["origin", "row_id"], "p6_found": ["origin", "row_id", "markup"], "p7_found": ["stratum_key"], "p8_ids": ["doc_id", "ids"],
    "p9_found": ["source"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, data, name):
    agree(spark, duck, data, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_runs_and_repeats_no_row(spark, data, name):
    df = ALL[name](spark, data)
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert df.count() == df.select(FOUND[name][:2]).distinct().count() or name in ("p1_found", "p6_found")


@pytest.fixture(scope="module")
def odd_tables(spark, data, tmp_path_factory):
    """The tables without rows, and with every row twice, rows of nulls, and columns that clash with the operators' own names."""
    root = tmp_path_factory.mktemp("odd")
    for name in os.listdir(data):
        df = spark.read.parquet(f"{data}/{name}")
        df.limit(0).write.parquet(f"{root}/empty/{name}")
        nulls = spark.createDataFrame([tuple(None for _ in df.columns)] * 3, df.schema)
        both = df.unionByName(df).unionByName(nulls) if name[:-8] in ("repo", "documents", "world", "repo_signals", "repo_fetch") else df
        extra = [c for c in ("rows", "key", "n", "r", "bucket", "points", "hash", "pos", "body", "rules", "segs", "u", "weight", "position") if c not in df.columns]
        both.selectExpr("*", *[f"'clash' as `{c}`" for c in extra]).write.parquet(f"{root}/odd/{name}")
    return root


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, odd_tables, name):
    assert ALL[name](spark, f"{odd_tables}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(n for n in ALL if n.endswith("found") or n in ("p2_clusters", "p3_ranking", "p5_groups", "p7_report", "p9_report", "p10_shared")))
def test_nulls_repeated_rows_and_clashing_columns(spark, data, odd_tables, name):
    odd = ALL[name](spark, f"{odd_tables}/odd")
    rows = {tuple(map(str, r)) for r in odd.collect()}
    if name in ("p1_found", "p2_found", "p5_found", "p6_found", "p7_found", "p10_found", "p3_found"):
        assert rows == {tuple(map(str, r)) for r in ALL[name](spark, data).collect()}


def test_ids_of_null_and_repeated_documents(spark, odd_tables):
    rows = ALL["p8_ids"](spark, f"{odd_tables}/odd").where("doc_id is null").collect()
    assert len(rows) == 3 and all(r.ids == [] for r in rows)

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratlas.operators import learn as B
from stratlas.operators import mutation as M
from stratlas.operators import scoring as S
from stratlas.operators import search as L
from stratlas.schemas import TABLES, SchemaDrift, assert_schema
from stratlas.sources import readers, tiles


def test_upsert_overwrites_coalesces_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id long, x string, y int")
    new = spark.createDataFrame([(2, None, None, 1), (2, "c", None, 2), (3, "d", 4, 1)], "id long, x string, y int, at int")
    got = {(r.id, r.x, r.y) for r in M.merge_upsert(old, new, ["id"], ["at"], ("y",)).collect()}
    assert got == {(1, "a", 1), (2, "c", 2), (3, "d", 4), (None, "n", 3)}


def test_layers_are_replaced_but_not_emptied(spark):
    edge = spark.createDataFrame([(1, 2, 0, 1.0), (1, 3, 1, 1.0)], "src long, dst long, kind int, weight double")
    rows = spark.createDataFrame([(5, 6, 0.5), (7, 7, 1.0)], "src long, dst long, weight double")
    got = {(r.src, r.dst, r.kind) for r in M.replace_layer(edge, 1, rows, symmetric=True).collect()}
    assert got == {(1, 2, 0), (5, 6, 1), (6, 5, 1)}
    with pytest.raises(M.EmptyLayer):
        M.replace_layer(edge, 1, rows.limit(0))
    assert M.replace_layer(edge, 1, rows.limit(0), allow_empty=True).count() == 1


def test_star_scale_is_monotone_and_repaired(spark):
    scale = S.repaired([(0, 100), (1, None), (5, 60), (10, 70), (50, 0), (100, 6), (1000, 2_000_000_000)])
    assert scale == [(0, 100), (5, 60), (100, 6)]
    rows = spark.range(0, 400).select(F.col("id").alias("stars"), S.at_least(F.col("id"), scale).alias("n"), S.star_rank(F.col("id"), scale).alias("r")).orderBy("stars").collect()
    assert all(a.n >= b.n for a, b in zip(rows, rows[1:])) and rows[0].r == 100 and rows[5].r == 60 and rows[-1].r == 6
    with pytest.raises(ValueError):
        S.at_least(F.lit(1), [])


def test_absent_signals_are_neutral(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None), (2, float("nan"), 0.0, 1.0, 0.0, 0.0)], "id long, stars double, dependents double, pagerank_ratio double, criticality double, stars_90d double")
    a, b = S.composite(df).orderBy("id").collect()
    assert a.score == b.score > 0
    with pytest.raises(ValueError):
        S.composite(df, {"stars": 0.0})


def test_allocation_keeps_floor_cells_and_total():
    sizes = {("a",): 10_000, ("b",): 100, ("c",): 2, ("d",): 0}
    out = B.allocate(sizes, 200)
    assert sum(out.values()) == 200 and out[("c",)] == 2 and out[("a",)] > out[("b",)] >= 3 and ("d",) not in out
    assert B.allocate({}, 10) == {}


def test_samples_and_splits_are_exact_and_repeatable(spark):
    strata = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("s"), F.lit(1).alias("d"), F.lit(0).alias("a"))
    one = sorted(r.id for r in B.teaching_sample(strata, 100).collect())
    assert len(one) == 100 and one == sorted(r.id for r in B.teaching_sample(strata.repartition(3), 100).collect())
    test = B.split(strata).groupBy("is_test").count().collect()
    assert {r.is_test: r["count"] for r in test} == {True: 67 + 133, False: 800}


def test_boosting_learns_what_can_be_learned(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 6))
    y = np.clip(50 + 15 * x[:, 0] + 10 * x[:, 1] * (x[:, 2] > 0), 0, 100)
    noise = rng.uniform(0, 100, 1200)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{j} double" for j in range(6)))
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, noise)) if i < 900], "id long, y double, z double")
    guess = B.predicted(table, B.train(table, targets)).where("id >= 900")
    truth = spark.createDataFrame([(i, float(y[i]), float(noise[i])) for i in range(900, 1200)], "id long, ty double, tz double")
    rows = guess.join(truth, "id")
    good = B.regression_scores(rows, "ty", "y", float(y[:900].mean())).first()
    bad = B.regression_scores(rows, "tz", "z", float(noise[:900].mean())).first()
    assert good.beats_baseline and good.r2 > 0.6 and not bad.beats_baseline


def test_fusion_and_names(spark):
    rows = spark.createDataFrame([(1, "o/parser", "fast parser of records", 5), (2, "o/other", "a parser", 50), (3, "parser/x", None, None)], "id long, full_name string, description string, stars int")
    assert [r.id for r in L.exact_name(rows, "Parser", 5).collect()] == [1]
    assert L.exact_name(rows, "two words", 5).collect() == [] and L.lexical(rows, "the", 5).collect() == []
    dense = spark.createDataFrame([(3, 0.9), (2, 0.1)], "id long, score double")
    assert [r.id for r in L.hybrid(rows, "parser", dense, 3).collect()][0] == 1
    with pytest.raises(ValueError):
        L.hybrid(rows, "a", None)


def test_schema_gate(spark):
    df = spark.createDataFrame([(1, 2, 0)], "src int, dst int, kind int")
    with pytest.raises(SchemaDrift):
        assert_schema(df, TABLES["edge"])
    assert assert_schema(df.selectExpr("*", "1D weight", "1D ppmi", "1 observations", "'x' extra"), TABLES["edge"]).columns[0] == "src"


def test_criticality_readers(spark, tmp_path):
    file = tmp_path / "c.csv"
    file.write_text("repo.url,default_score\nhttps://github.com/A/b/,0.5\nhttps://example.com/a/b,0.4\nhttps://github.com/a/c,oops\n")
    assert [tuple(r) for r in readers.criticality_strict(spark, str(file)).collect()] == [("a/b", 0.5)]
    names = spark.createDataFrame([("a/B",)], "full_name string")
    assert [tuple(r) for r in readers.criticality_lenient(spark, str(file), names).collect()] == [("A/b", 0.5)]
    file.write_text("repo.url,default_score\nhttps://github.com/A/b,1.5\n")
    with pytest.raises(PySparkException):
        readers.criticality_strict(spark, str(file)).collect()
    file.write_text("url,x\n")
    with pytest.raises(readers.BadDump):
        readers.criticality_strict(spark, str(file))


def test_tiles_and_graphs_round_trip():
    rows = [{"theta": -5, "phi": 65535, "size": 7, "domain": 3, "flags": 5, "id": 2**31}, {"theta": 9, "phi": 0, "size": 1, "domain": 0, "flags": 0, "id": 1}]
    raw = tiles.encode_tile(rows)
    assert len(raw) == 16 + 24 and [tuple(r) for r in tiles.decode_tile(raw)] == [tuple(r[n] for n in tiles.TILE_TYPE.names) for r in rows]
    for bad in (b"", raw[:-1], b"XXXX" + raw[4:]):
        with pytest.raises(tiles.BadFile):
            tiles.decode_tile(bad)
    g = tiles.encode_graph(np.array([0.6, 0.4]), np.array([0, 1, 2]), np.array([1, 0]), np.array([0, 1]), np.array([1, 32769]))
    out = tiles.decode_graph(g)
    assert tiles.check_graph(out) == [] and list(out["weights"]) == [1, 32769]
    broken = tiles.decode_graph(tiles.encode_graph(np.array([0.2, 0.4]), np.array([0, 1, 1]), np.array([1]), np.array([]), np.array([1])))
    assert {"ranks don't sum to 1", "ranks rise", "not symmetric"} <= set(tiles.check_graph(broken))


def test_requirements_skip_optional_ones(spark):
    rows = spark.createDataFrame([("a", "1", [("b", False, None), ("c", True, None), ("d", None, "dev"), ("e", None, "runtime")])], "name string, version string, dependencies array<struct<name: string, optional: boolean, kind: string>>")
    assert sorted(r.requires for r in readers.requirements({"x": rows}).collect()) == ["b", "e"]


def test_names_of_files_and_cost_gate(spark, tmp_path):
    (tmp_path / "names-0.json").write_text('["a/b", "plain", "c/d"]')
    assert sorted((r.full_name, r.pos) for r in readers.names_of_files(spark, str(tmp_path)).collect()) == [("a/b", 0), ("c/d", 2)]
    df = spark.read.text(str(tmp_path))
    assert readers.within_budget(df, 1 << 40) is df
    with pytest.raises(readers.TooCostly):
        readers.within_budget(df, 0)


def test_days_are_fractional(spark):
    from stratlas.functions.bands import days_before

    df = spark.createDataFrame([(dt.datetime(2025, 12, 31, 12),)], "t timestamp_ntz")
    assert df.select(days_before("t", "2026-01-01 00:00:00")).first()[0] == 0.5


def test_run_log_and_ingest_state(spark):
    runs = M.append_run(M.append_run(None, spark, name="a", rows=5), spark, name="b", ok=True)
    assert {(r.name, r.rows, r.ok) for r in runs.collect()} == {("a", 5, None), ("b", None, True)}
    state = spark.createDataFrame([("s1", "c1", 10, False)], TABLES["ingest_state"])
    state = M.advance(M.advance(state, "s1", "c2", 7, False), "s2", None, 3, True)
    assert {tuple(r) for r in state.collect()} == {("s1", "c2", 17, False), ("s2", None, 3, True)}
    assert M.reset(state, "s1").count() == 1 and M.reset(state).count() == 0

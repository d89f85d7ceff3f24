from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratlas.operators import sphere as H
from stratlas.operators import vectors as V


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")


def blobs(n, d, k, seed=0, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = V.unit_rows(rng.normal(size=(k, d)))
    labels = rng.integers(0, k, n)
    return V.unit_rows(centres[labels] + noise * rng.normal(size=(n, d))), labels


def test_nearest_is_exact(spark):
    m, _ = blobs(300, 16, 5)
    df = vectors(spark, m)
    got = {}
    for r in V.nearest(df.where("id % 100 = 0"), df, "id", "v", 7).collect():
        got.setdefault(r.query, []).append((r.r, r.id))
    c = m @ m.T
    for q in (0, 100, 200):
        c[q, q] = -9
        assert [i for _, i in sorted(got[q])] == list(np.argsort(-c[q])[:7])


def test_index_recall_against_brute_force(spark):
    m, _ = blobs(2000, 32, 12, noise=0.2)
    df = vectors(spark, m)
    asked = df.where("id % 100 = 0")
    exact = {(r.query, r.id) for r in V.nearest(asked, df, "id", "v", 10).collect()}
    found = {(r.query, r.id) for r in V.ListIndex(df, "id", "v", 16, 1000, 8).nearest(asked, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_vectors_without_structure_are_found_too(spark):
    m = V.unit_rows(np.random.default_rng(4).normal(size=(1500, 16)))
    df = vectors(spark, m)
    asked = df.where("id % 25 = 0")
    exact = {(r.query, r.id) for r in V.nearest(asked, df, "id", "v", 10).collect()}
    index = V.ListIndex(df, "id", "v", 16, 1000)
    found = {(r.query, r.id) for r in index.nearest(asked, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9 and index.probes <= 16


def test_whitening_takes_the_cone_out(spark):
    rng = np.random.default_rng(1)
    m = V.unit_rows(rng.normal(size=(400, 24)) + 3 * rng.normal(size=24))
    df = vectors(spark, m)
    mean, axes = V.fit_whitening(df, "v", 24, 1)
    after = V.pair_cosine(V.sums_by(V.whiten(df.withColumn("v", V.doubles("v")), "v", mean, axes), "v", 24)).first()["cosine"]
    before = V.pair_cosine(V.sums_by(df, "v", 24)).first()["cosine"]
    assert before > 0.5 and abs(after) < 0.01


def test_kmeans_recovers_planted_groups(spark):
    m, labels = blobs(240, 12, 4, noise=0.05)
    got = {r.id: r.label for r in V.spherical_kmeans(vectors(spark, m), "id", "v", 4, 12, 20)[0].collect()}
    pairs = [(got[i] == got[j]) == (labels[i] == labels[j]) for i in range(240) for j in range(i)]
    assert np.mean(pairs) > 0.99


def test_packed_vectors_round_trip_and_wrong_widths_raise(spark):
    df = vectors(spark, np.eye(4)).withColumn("b", V.packed("v"))
    assert [list(r.u) for r in df.select(V.unpacked("b", 4).alias("u")).collect()] == [list(r.v) for r in df.collect()]
    with pytest.raises(PySparkException):
        df.select(V.unpacked("b", 5)).collect()
    with pytest.raises(PySparkException):
        V.check_width(df, "v", 3).collect()


def test_null_zero_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "id long, v array<float>")
    assert [r.n for r in df.orderBy("id").select(V.normalised(F.col("v")).alias("n")).collect()] == [None, [0.0, 0.0], [0.6, 0.8]]
    assert V.nearest(df.limit(0), df, "id", "v", 3).collect() == []
    assert V.search(df.limit(0), "id", "v", [1.0, 0.0], 3).collect() == []


def test_going_over_the_pole(spark):
    df = spark.createDataFrame([(math.pi + 0.1, 0.5), (-0.2, 1.0), (0.3, 7.0)], "t double, p double")
    t, p = H.wrapped(F.col("t"), F.col("p"))
    rows = df.select(*[F.round(c, 9).alias(n) for c, n in zip(H.xyz(F.col("t"), F.col("p")), "abc")], *[F.round(c, 9).alias(n) for c, n in zip(H.xyz(t, p), "xyz")], t.alias("t")).collect()
    for r in rows:
        assert (r.a, r.b, r.c) == pytest.approx((r.x, r.y, r.z)) and 0 <= r.t <= math.pi


def test_opposite_positions_fall_back_to_the_first(spark):
    df = spark.createDataFrame([(1, "g", 0.0, 1.0, 0.0), (2, "g", 0.0, -1.0, 0.0)], "repo_id long, k string, x double, y double, z double")
    r = H.spherical_means(df, "k").first()
    assert (r.mx, r.my, r.mz) == (0.0, 1.0, 0.0) and r.r < 1e-9


def test_regions_query_has_a_region_for_every_20_records_and_12_domains(spark, tmp_path):
    from stratlas.plans.catalogue import QUERIES

    spark.range(1000).select(F.col("id").alias("repo_id"), F.acos(2 * F.rand(1) - 1).alias("theta"), (F.rand(2) * 6.28).alias("phi")).write.parquet(f"{tmp_path}/world.parquet")
    rows = QUERIES["regions"](spark, str(tmp_path)).collect()
    assert len(rows) == 1000 and len({r.region for r in rows}) == 50 and len({r.domain for r in rows}) == 12


def test_farthest_start_in_pools_takes_the_same_rows_as_one_pass_each(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    want = [0]
    while len(want) < 12:
        want.append(int(np.argmin(np.round((v @ v[want].T).max(1), 9))))
    assert np.allclose(V.spherical_kmeans(df, "id", "v", 12, 64, 0)[1], v[want])

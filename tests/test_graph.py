from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException

from stratlas.operators import graph as G
from stratlas.operators.ordering import global_positions


def nodes(spark, n):
    return spark.range(n)


def edges(spark, rows):
    return spark.createDataFrame([(*r, 1.0) if len(r) == 2 else r for r in rows], "src long, dst long, weight double")


def reference_rank(n, rows, d=0.85, rounds=300):
    out = {}
    for s, t, w in rows:
        out.setdefault(s, {})
        out[s][t] = out[s].get(t, 0) + w
    r = [1 / n] * n
    for _ in range(rounds):
        lost = sum(r[i] for i in range(n) if i not in out)
        new = [(1 - d) / n + d * lost / n] * n
        for s, ts in out.items():
            for t, w in ts.items():
                new[t] += d * r[s] * w / sum(ts.values())
        r = new
    return r


def test_pagerank_of_known_graphs(spark):
    ring = {r.id: r.rank for r in G.pagerank(nodes(spark, 4), edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])).collect()}
    assert all(abs(v - 0.25) < 1e-9 for v in ring.values())
    none = {r.id: r.rank for r in G.pagerank(nodes(spark, 5), edges(spark, [])).collect()}
    assert all(abs(v - 0.2) < 1e-9 for v in none.values())
    star = {r.id: r.rank for r in G.pagerank(nodes(spark, 5), edges(spark, [(i, 0) for i in range(1, 5)])).collect()}
    assert star[0] == max(star.values()) and abs(sum(star.values()) - 1) < 1e-9


def test_pagerank_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.randrange(30), rng.random()) for _ in range(80)]
    got = {r.id: r.rank for r in G.pagerank(nodes(spark, 30), edges(spark, rows), tolerance=1e-12, most=120).collect()}
    assert all(abs(got[i] - x) < 1e-8 for i, x in enumerate(reference_rank(30, rows)))


def test_pagerank_rejects_negative_weights_and_takes_an_empty_graph(spark):
    with pytest.raises(PySparkException):
        G.pagerank(nodes(spark, 2), edges(spark, [(0, 1, -1.0)])).collect()
    assert G.pagerank(nodes(spark, 0), edges(spark, [])).collect() == []


def test_components_of_chains_rings_and_isolated_nodes(spark):
    rows = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = {r.id: r.component for r in G.components(nodes(spark, 62), edges(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[50] == got[51] == got[52] == 50
    assert got[45] == 45 and got[60] == 60 and len(got) == 62


def test_planted_communities_are_found(spark):
    rng = random.Random(0)
    rows = [(i, j) for i in range(80) for j in range(i + 1, 80) if rng.random() < (0.4 if i // 20 == j // 20 else 0.01)]
    got = {r.id: r.label for r in G.communities(nodes(spark, 80), edges(spark, rows)).collect()}
    agree = total = 0
    for i in range(80):
        for j in range(i + 1, 80):
            agree += (got[i] == got[j]) == (i // 20 == j // 20)
            total += 1
    assert agree / total > 0.95
    labels = spark.createDataFrame(list(got.items()), "id long, label long")
    assert G.modularity(edges(spark, rows), labels).first()[0] > 0.3


def test_stability_falls_with_time_and_prefers_the_planted_groups(spark):
    rng = random.Random(2)
    rows = [(i, j) for i in range(24) for j in range(i + 1, 24) if rng.random() < (0.6 if i // 8 == j // 8 else 0.03)]
    planted = spark.createDataFrame([(i, i // 8) for i in range(24)], "id long, label int")
    mixed = spark.createDataFrame([(i, i % 3) for i in range(24)], "id long, label int")
    short, long_ = G.stability(edges(spark, rows), planted, 0.5), G.stability(edges(spark, rows), planted, 3.0)
    assert short > long_ > G.stability(edges(spark, rows), mixed, 3.0)


def test_packed_entries_round_trip(spark):
    rows = spark.createDataFrame([(1, 2, 0, 1.0), (2, 3, 2, 0.25), (3, 1, 1, 0.0)], "src long, dst long, kind int, weight double")
    back = {(r.row, r.target): (r.outgoing, r.kind, r.weight) for r in G.decoded_entries(G.packed_entries(rows)).collect()}
    assert back[(1, 2)] == (True, 0, 1.0) and back[(2, 1)] == (False, 0, 1.0)
    assert back[(2, 3)][1] == 2 and abs(back[(2, 3)][2] - 0.25) < 1 / 8191


def test_positions_with_heavy_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.0, 0.0, 0.0, 1.0, 5.0, rng.random()])) for i in range(500)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id long, v double")
    got = [r.id for r in global_positions(df, "v", F.col("id")).orderBy("position").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_backbone_keeps_its_bounds(spark):
    rows = edges(spark, [(0, i, 1.0 / i) for i in range(1, 20)])
    ranks = spark.createDataFrame([(i, 1.0) for i in range(20)], "id long, rank double")
    assert [(r.src, r.dst) for r in G.backbone(rows, ranks, 900, 4).collect()] == [(0, 1), (0, 2), (0, 3), (0, 4)]


def test_backbone_goes_on_below_a_hub_that_is_full(spark):
    rng = random.Random(4)
    rows = [(0, i, 9.0 + i / 1000) for i in range(1, 400)] + [(i, 0, 8.0 + i / 1000) for i in range(1, 400)]
    rows += [(rng.randrange(1, 60), rng.randrange(1, 60), rng.random()) for _ in range(300)]
    ranks = {i: 1.0 + i % 7 for i in range(400)}
    used, taken, want = {}, set(), []
    for s, t, w in sorted(((s, t, w * (ranks[s] * ranks[t]) ** 0.5) for s, t, w in rows), key=lambda r: (-r[2], r[0], r[1])):
        if s != t and frozenset((s, t)) not in taken and used.get(s, 0) < 2 and used.get(t, 0) < 2 and len(want) < 8:
            taken.add(frozenset((s, t)))
            want.append((s, t))
            used |= {s: used.get(s, 0) + 1, t: used.get(t, 0) + 1}
    got = G.backbone(edges(spark, rows), spark.createDataFrame(list(ranks.items()), "id long, rank double"), 8, 2)
    assert len(want) == 8 and [(r.src, r.dst) for r in got.collect()] == want


def test_communities_of_a_long_chain_grow_until_modularity_rests(spark):
    chain = edges(spark, [(i, i + 1) for i in range(400)])
    score = lambda **cut: G.modularity(chain, G.communities(nodes(spark, 401), chain, **cut)).first()[0]
    assert score() > 0.66 > 0.53 > score(levels=2, passes=4)


def test_community_sweep_runs_every_source_and_resolution(spark, data):
    from stratlas.plans.catalogue import QUERIES

    rows = QUERIES["community_sweep"](spark, data).collect()
    assert {(r.source, r.resolution) for r in rows} == {(s, g) for s in ("all", "deps", "similar") for g in (20.0, 10.0, 5.0, 2.0, 1.0, 0.5)}
    for source in ("all", "deps", "similar"):
        many = [r.communities for r in sorted(rows, key=lambda r: -r.resolution) if r.source == source]
        assert many[0] >= many[-1]


def test_community_sweep_takes_few_jobs(spark, data):
    from stratlas.plans.catalogue import QUERIES

    spark.sparkContext.setJobGroup("sweep", "jobs of the sweep")
    rows = QUERIES["community_sweep"](spark, data).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sweep")
    spark.sparkContext.setJobGroup("", "")
    assert len(rows) == 18 and len(jobs) < 60  # passes of small graphs are no jobs


def test_runs_in_tasks_move_as_those_by_joins(spark):
    rng = random.Random(7)
    rows = [(i, j, rng.choice([None, 0.0, rng.random()])) for i in range(60) for j in range(60) if rng.random() < (0.25 if i // 12 == j // 12 else 0.02)]
    some, known = edges(spark, rows), nodes(spark, 70).where("id <> 5").unionByName(spark.createDataFrame([(None,), (3,)], "id long"))  # 5 is an end but no node, 3 stands twice
    sources = {"all": some, "none": some.limit(0), "zero": edges(spark, [(1, 2, 0.0)])}
    whole = [tuple(r) for r in G.sweep(known, sources, (3.0, 0.5)).collect()]
    assert whole == [tuple(r) for r in G.sweep(known, sources, (3.0, 0.5), in_task=0).collect()]
    assert [r[2:] for r in whole if r[0] != "all"] == [(70, 1, None)] * 4
    for loose in (0, 40):  # all levels by joins; those after the first in a task
        got = G.many_communities(known, some.withColumn("run", G.F.lit(0)), {0: 1.0}, in_task=loose)
        assert sorted((r.id or 0, r.label or 0) for r in got.collect()) == sorted((r.id or 0, r.label or 0) for r in G.communities(known, some).collect())


def test_sizes_of_a_sweep_in_tasks_count_lone_nodes(spark):
    pair = edges(spark, [(0, 1, 2.0), (1, 0, 1.0), (8, 9)])
    rows = G.sweep(nodes(spark, 6), {"x": pair}, (1.0,)).collect()
    assert [tuple(r) for r in rows] == [("x", 1.0, 5, 2, 0.0)]  # 2 to 5 alone; 8 and 9 are no nodes

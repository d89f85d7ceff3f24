from __future__ import annotations

import math
import random

import numpy as np
import pytest

from stratlas.llm import borda, clusters, spans, stratified

WORLD = "repo_id long, theta double, phi double, cluster_id int, n int, x double"


def sphere(spark, points):
    return spark.createDataFrame([(i, t, p, 1, 2, 3.0) for i, t, p in points], WORLD)


def around(rng, t, p, spread, n):
    return [(t + rng.uniform(-spread, spread), p + rng.uniform(-spread, spread) / math.sin(t)) for _ in range(n)]


def cliques_by_hand(points, angle=0.001, least=5):
    ids = np.array([i for i, _, _ in points])
    t, p = np.array([a for _, a, _ in points]), np.array([b for _, _, b in points])
    v = np.c_[np.sin(t) * np.cos(p), np.cos(t), np.sin(t) * np.sin(p)]
    near = np.linalg.norm(v[:, None] - v[None], axis=2) <= 2 * math.sin(angle / 2)
    out = set()
    for i in range(len(ids)):
        group = near[i]
        if group.sum() >= least and all((near[j] == group).all() for j in np.flatnonzero(group)):
            out.add((int(ids[i]), int(ids[group].min())))
    return out


def test_cliques_match_brute_force(spark):
    rng = random.Random(8)
    spots = []
    for _ in range(60):
        t, p = rng.uniform(0.3, 2.8), rng.uniform(0, 6.2)
        spots += around(rng, t, p, rng.choice([0.0001, 0.0003, 0.0005, 0.001]), rng.choice([3, 5, 8, 20]))
    spots += [(1.0, 1.0)] * 30 + [(1.0, 1.0 + 2 * math.pi)] * 3  # copies of a position, one of them a turn away
    spots += [(1.5 + 0.0008 * k, 2.0) for k in range(9)]  # a chain: connected, but no clique
    spots += [(2.0, 3.0), (2.0, 3.0), (2.0, 3.0), (2.0, 3.0), (2.0, 3.0), (2.0009, 3.0)] + [(2.0018, 3.0)]  # one more near a member only
    points = [(1000 - i, t, p) for i, (t, p) in enumerate(spots)]
    assert cliques_by_hand(points)
    odd = [(None, 1.0, 1.0), (5000, None, 1.0), (5001, float("nan"), 1.0), (5002, 1.0, float("inf"))]
    got = {tuple(r) for r in clusters.cliques(sphere(spark, points + odd)).collect()}
    assert got == cliques_by_hand(points)


def test_a_hot_cluster_and_the_report(spark):
    rng = random.Random(9)
    hot = around(rng, 1.2, 0.4, 0.0002, 3000)
    rest = [(rng.uniform(0.2, 2.9), rng.uniform(0, 6.2)) for _ in range(600)]
    df = sphere(spark, [(i, t, p) for i, (t, p) in enumerate(hot + rest)])
    got = clusters.cliques(df).collect()
    assert {r.repo_id for r in got} == set(range(3000)) and {r.cluster_key for r in got} == {0}
    report = clusters.cluster_report(df).orderBy("size", ascending=False).collect()
    assert sum(r["size"] for r in report) == 3600 and report[0]["size"] == 3000 and len(report[0]["typical_ids"]) == 3


def test_heavy_spots_lose_no_light_clique(spark):
    """Light cliques beside heavy ones: no centre of the agglomeration may drift away from them."""
    along = [(-1.04, 5), (0.0, 50), (0.3, 50), (1.28, 10_000), (4.0, 3), (5.9, 300), (7.2, 6)]
    points = [(1.2, 1.0 + step * 0.001 / math.sin(1.2)) for step, n in along for _ in range(n)]
    got = {tuple(r) for r in clusters.cliques(sphere(spark, [(i, t, p) for i, (t, p) in enumerate(points)])).collect()}
    light = {(i, 0) for i in range(5)}
    assert light <= got and {k for _, k in got} == {0, 10_408, 10_108}


@pytest.mark.parametrize("seed", [3, 4])
def test_cliques_of_any_weight_match_brute_force(spark, seed):
    """Chains of spots along great circles, of 1 to 10,000 records each, against all pairs of spots."""
    rng = random.Random(seed)
    spots = []
    for _ in range(25):
        t, p = rng.uniform(0.5, 2.6), rng.uniform(0, 6)
        for _ in range(rng.randrange(1, 9)):
            spots.append((t, p, rng.choice([1, 2, 4, 5, 40, 400, 2000])))
            t, p = t + rng.uniform(-0.0012, 0.0012), p + rng.uniform(-0.0012, 0.0012)
    ids, owner = 0, []
    for s, (_, _, n) in enumerate(spots):
        owner += [s] * n
    rng.shuffle(owner)
    first, size = {}, {}
    for i, s in enumerate(owner):
        first.setdefault(s, i)
        size[s] = size.get(s, 0) + 1
    v = np.array([(math.sin(t) * math.cos(p), math.cos(t), math.sin(t) * math.sin(p)) for t, p, _ in spots])
    near = np.linalg.norm(v[:, None] - v[None], axis=2) <= 2 * math.sin(0.0005)
    want = set()
    for s in range(len(spots)):
        group = np.flatnonzero(near[s])
        if all((near[j] == near[s]).all() for j in group) and sum(size[j] for j in group) >= 5:
            want |= {(i, min(first[j] for j in group)) for i, o in enumerate(owner) if o == s}
    df = sphere(spark, [(i, spots[s][0], spots[s][1]) for i, s in enumerate(owner)])
    assert want and {tuple(r) for r in clusters.cliques(df).collect()} == want


def test_a_dense_clique_is_settled_by_cells(spark):
    """Thousands of different positions well inside the angle need no look at the positions; at its edge they do."""
    rng = np.random.default_rng(4)
    lo, hi = rng.uniform(0, 0.0004, (3000, 3)), None
    hi = lo.copy()
    verdict, group, _ = clusters.clique_of(0, lo, hi + 1e-6, np.ones(3000), 0.001, 5)
    assert verdict == clusters.CLIQUE and len(group) == 3000
    pair = np.array([[0.0, 0, 0], [0.00099, 0, 0]])
    assert clusters.clique_of(0, pair, pair, np.array([3, 3]), 0.001, 5)[0] == clusters.CLIQUE
    assert clusters.clique_of(0, pair, pair + 2e-5, np.array([3, 3]), 0.001, 5)[0] == clusters.UNSURE
    spots = [(1.0 + rng.uniform(0, 0.00055), 2.0 + rng.uniform(0, 0.0008)) for _ in range(2500)]
    points = [(i, t, p) for i, (t, p) in enumerate(spots)]
    assert {tuple(r) for r in clusters.cliques(sphere(spark, points)).collect()} == cliques_by_hand(points)


def test_feature_trees_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    tree = clusters.FeatureTree(0.4)
    for row in clusters.single(x, np.ones(500)):
        tree.add(row)
    whole = clusters.total(tree.leaves())
    assert whole[0] == 500 and np.allclose(whole[1:4], x.sum(0)) and np.isclose(whole[4], (x**2).sum())
    assert np.array_equal(whole[5:8], x.min(0)) and np.array_equal(whole[8:], x.max(0))
    cells = clusters.collapsed(clusters.single(x, np.ones(500)), 0.5)
    assert len(cells) < 500 and np.allclose(clusters.total(cells), whole)
    same = clusters.FeatureTree(0.0)
    for row in clusters.single(np.ones((200, 3)), np.ones(200)):
        same.add(row)
    assert same.leaves()[:, 0].sum() == 200
    done = clusters.ward(clusters.single(rng.uniform(0, 5, (300, 3)), rng.integers(1, 999, 300).astype(float)), 1.2, 1.2, 0.6)
    assert all(clusters.farthest(f) <= 1.2 for f in done)


SIGNALS = "repo_id long, stars double, dependents double, pagerank_ratio double, stars_90d double, points double"


def borda_by_hand(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    best = {i: [max([r[c] for r in rows if r[0] == i and r[c] is not None and r[c] == r[c]], default=None) for c in range(1, 5)] for i in ids}
    out = dict.fromkeys(ids, 0.0)
    for c in range(4):
        known = [best[i][c] for i in ids if best[i][c] is not None]
        for i in ids:
            v = best[i][c]
            out[i] += (len(known) + 1) / 2 if v is None else sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2
    return out


def test_points_match_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), 0.0, -0.0, 0.0, 0.0, 1.0, rng.expovariate(0.001)])
    rows = [(i, value(), value(), value(), value(), 1.0) for i in range(400)]
    rows += rows[:50] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SIGNALS)
    points = borda.borda_points(df)
    assert {r.id: r.points for r in points.collect()} == borda_by_hand(rows)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 399), (7, 5000), (None, 1)], "repo_a long, repo_b long")
    want = borda_by_hand(rows)
    higher = {(r.repo_a, r.repo_b): r.higher_id for r in borda.higher_of(pairs, points).collect()}
    assert higher == {p: (p[0] if want[p[0]] >= want[p[1]] else p[1]) for p in [(1, 2), (3, 399)]}


def test_one_wide_score_does_not_dominate(spark):
    df = spark.createDataFrame([(1, 1e9, 1.0, 1.0, 1.0, 0.0), (2, 5.0, 2.0, 2.0, 2.0, 0.0), (3, 4.0, 3.0, 3.0, 3.0, 0.0)], SIGNALS)
    assert max(borda.borda_points(df).collect(), key=lambda r: r.points).id == 3


def test_raking_meets_the_margins():
    cells = {(a, b): 10 * (a + 1) * (b + 2) + 7 * (a == b) for a in range(3) for b in range(4)}
    goals = [{0: 0.5, 1: 0.3, 2: 0.2}, {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}]
    weights = stratified.rake(cells, goals)
    for axis, goal in enumerate(goals):
        for name, share in goal.items():
            assert abs(sum(weights[k] * cells[k] for k in cells if k[axis] == name) - share) < 1e-6


def test_a_sample_meets_what_it_can_and_reports_the_rest(spark):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 > 0 then 's0_d00_a0' when id < 30 then 's1_d00_a0' else 's0_d01_a0' end as stratum_key")
    targets = spark.createDataFrame([("s0_d00_a0", 0.5, 1, 200), ("s1_d00_a0", 0.3, 2, 200), ("s0_d01_a0", 0.2, 60, 200), ("s2_d00_a0", 0.0, 4, 200)], "stratum_key string, target_share double, min_count int, sample_size long")
    table, weights = stratified.plan_sample(rows, targets)
    sample = stratified.draw(rows, table, weights)
    report = {r.stratum_key: r for r in stratified.sample_report(table, sample).collect()}
    assert {k: r.gap for k, r in report.items()} == {"s0_d00_a0": 0, "s1_d00_a0": 50, "s0_d01_a0": 0, "s2_d00_a0": 4}
    assert all(r.drawn == r.allocation for r in report.values()) and report["s1_d00_a0"].drawn == 10 and report["s0_d01_a0"].drawn >= 60
    assert sum(r.drawn for r in report.values()) == 200
    again = {r.id for r in stratified.draw(rows.repartition(3), table, weights).collect()}
    assert again == {r.id for r in sample.collect()} and len(again) == 200


def test_half_shares_are_rounded_up(spark):
    rows = spark.range(10).selectExpr("id", "'s0_d00_a0' as stratum_key")
    targets = spark.createDataFrame([("s0_d00_a0", 0.25, 0, 10)], "stratum_key string, target_share double, min_count int, sample_size long")
    assert stratified.plan_sample(rows, targets)[0].first().wanted == 3


TARGETS = "stratum_key string, target_share double, min_count int, sample_size long"


def test_what_a_short_stratum_leaves_goes_where_its_margins_lack(spark):
    """s1_d0 has too few: the other strata of s1 and of d0 are raked up, s0_d1 is not, and the margins come out as wanted."""
    sizes = {"s0_d0": 2000, "s0_d1": 2000, "s1_d0": 40, "s1_d1": 2000}
    rows = spark.createDataFrame([(i * 10 + k, name) for k, (name, n) in enumerate(sizes.items()) for i in range(n)], "id long, stratum_key string")
    table, weights = stratified.plan_sample(rows, spark.createDataFrame([(k, 0.25, 10, 400) for k in sizes], TARGETS))
    got = {r.stratum_key: r for r in table.collect()}
    assert got["s1_d0"].allocation == 40 and got["s1_d0"].gap == 60 and sum(r.allocation for r in got.values()) == 400
    assert all(got[k].allocation >= 100 for k in sizes if k != "s1_d0")
    assert got["s0_d0"].allocation > got["s0_d1"].allocation and got["s1_d1"].allocation > got["s0_d1"].allocation
    other = stratified.plan_sample(rows, spark.createDataFrame([(k, 0.25, 10, 400) for k in sizes], TARGETS), {"stratum_key": {k: 0.25 + 0.1 * (k == "s0_d1") for k in sizes}})
    assert {r.stratum_key: r.allocation for r in other[0].collect()} != {k: r.allocation for k, r in got.items()}


def test_a_margin_across_strata_sets_the_weights_within_them(spark):
    """A third of each stratum is old; the target wants half: old records weigh more, and the sample follows the weights."""
    rows = spark.range(6000).selectExpr("id", "concat('s', id % 2, '_d0') as stratum_key", "case when id % 3 = 0 then 'old' when id % 600 = 1 then null else 'new' end as age")
    targets = spark.createDataFrame([("s0_d0", 0.7, 1, 600), ("s1_d0", 0.3, 1, 600)], TARGETS)
    table, weights = stratified.plan_sample(rows, targets, {"age": {"old": 0.5, "new": 0.5}})
    by = {(r.stratum_key, r.age): r.weight for r in weights.collect()}
    assert by["s0_d0", "old"] > 1.8 * by["s0_d0", "new"]
    sample = stratified.draw(rows, table, weights).join(rows.select("id", "age"), "id").collect()
    assert len(sample) == 600 == len({r.id for r in sample}) and sum(r.stratum_key == "s0_d0" for r in sample) == 420
    assert abs(sum(r.age == "old" for r in sample) - 300) < 45
    plain = stratified.draw(rows, *stratified.plan_sample(rows, targets)).join(rows.select("id", "age"), "id").collect()
    assert sum(r.age == "old" for r in plain) < 250 and {r.id for r in plain} != {r.id for r in sample}


def test_raked_counts_match_plain_fitting_and_never_overdraw():
    rng = np.random.default_rng(1)
    cells = {(f"{s}{d}", s, d): float(rng.integers(5, 400)) for s in "abc" for d in "xyz"}
    goal = [{k[0]: 1 / 9 for k in cells}, dict.fromkeys("abc", 1 / 3), dict.fromkeys("xyz", 1 / 3)]
    counts, _ = stratified.raked_counts(cells, goal, 30)
    assert all(abs(n - 30 / 9) < 1e-6 for n in counts.values())  # all targets can be met: each cell has its share
    counts, _ = stratified.raked_counts(cells, goal, 900)
    assert all(n <= cells[k] + 1e-9 for k, n in counts.items()) and sum(counts.values()) <= 900 + 1e-6


def pairs_by_hand(docs, least=200):
    grams = {}
    for i, t in docs:
        if i is not None and t:
            for p in range(len(t) - least + 1):
                grams.setdefault(t[p : p + least], set()).add(i)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def span_docs(rng):
    alphabet = "abcdefghij klmno\nüß日本🚀"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 230, 400, 900)]
    docs = []
    for i in range(120):
        body = text(rng.randrange(0, 500))
        for _ in range(rng.choice([0, 1, 1, 2])):
            s = rng.choice(shared)
            at = rng.randrange(len(body) + 1)
            body = body[:at] + s + body[at:]
        docs.append((i, body))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans_match_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = span_docs(rng)
    docs += [(200 + k, docs[5][1]) for k in range(3)] + [(300, "ab" * 700), (301, "x" + "ab" * 400), (302, "a" * 2500), (303, "a" * 199), (304, "a" * 200), (305, None), (None, docs[5][1]), (306, "")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, hash string, pos int")
    members, links = spans.shared_spans(df)
    assert {tuple(r) for r in spans.span_pairs(members, links).collect()} == pairs_by_hand(docs)
    report = {r.doc_id: r for r in spans.shared_report(df, members, links).collect()}
    partners = {}
    for a, b in pairs_by_hand(docs):
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    assert {i for i, r in report.items() if r.shared_chars > 0} == set(partners)
    assert all(r.shared_chars <= r.n_chars for r in report.values())
    assert report[304].shared_chars == 200 and report[303].shared_chars == 0 and report[201].share == 1.0


def test_a_hot_passage_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 7)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = text(260)
    docs = [(i, text(40) + hot + text(30)) for i in range(60)] + [(100 + i, text(300)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spans.span_pairs(*spans.shared_spans(df)).collect()} == pairs_by_hand(docs)


def test_further_copies_of_a_passage_in_a_record_are_counted(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(1500)
    docs = [(1, text(300) + "X" + passage + "Y" + text(300) + "Z" + passage + "V" + text(100)), (2, "P" + passage + "Q" + text(50)), (3, text(900))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    report = {r.doc_id: r for r in spans.shared_report(df, *spans.shared_spans(df)).collect()}
    assert [report[i].shared_chars for i in (1, 2, 3)] == [3000, 1500, 0]

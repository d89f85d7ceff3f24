"""Clients, settings, stores, single flight, bases, pages cleaned again, domains of communities."""

from __future__ import annotations

import json
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratlas import serving
from stratlas.functions import text as T
from stratlas.functions.judgement import DIMENSIONS
from stratlas.operators import density, mutation, ordering, sphere, vectors
from stratlas.session import materialise, release, work_path
from stratlas.settings import Settings, pool
from stratlas.sources import stores, teacher, tiles


def test_a_pool_of_keys_wins_over_a_single_one():
    assert pool({"KS": "a, b,,a", "K": "c"}, "KS", "K") == ["a", "b"] and pool({"KS": " ", "K": "c"}, "KS", "K") == ["c"] and pool({}, "KS", "K") == []
    assert Settings.read({"TEACHER_KEY": "x", "CONCURRENCY": "3"}) == Settings((), (), ("x",), 40.0, 3)
    with pytest.raises(ValueError):
        Settings.read({"CONCURRENCY": "many"})


GOOD = json.dumps({d: 50 for d in DIMENSIONS} | {"summary": "fine"})


def ask(question):
    if "bad" in question:
        return "no idea"
    if "odd" in question:
        raise RuntimeError("boom")
    return GOOD


def test_a_failed_judgement_costs_its_row_only():
    assert teacher.judge("Project: a", ask)["maintenance"] == 50.0 and teacher.judge("Project: bad", ask) == {"failure": "unparseable"}
    assert teacher.judge("Project: odd", ask)["failure"] == "RuntimeError" and teacher.judge("Project: a\nstars: 12", ask)["failure"] == "Leak"
    calls = []

    def flaky(q):
        calls.append(q)
        if len(calls) < 3:
            raise ConnectionError
        return GOOD

    assert teacher.judge("q", flaky, sleep=lambda s: None)["failure"] is None and len(calls) == 3


def test_teaching_goes_on_where_it_ended(spark):
    names = ["a/one", "b/bad", "c/odd", *[f"x/p{i}" for i in range(20)], None]
    rows = spark.createDataFrame([(i, n, None, "text", "clash") for i, n in enumerate(names)], "id long, full_name string, description string, clean_text string, failure string")
    path = work_path(spark, "taught")
    first = {r.id: r.failure for r in teacher.teach(rows.where("id < 5"), ask, path, every=2).collect()}
    assert first == {0: None, 1: "unparseable", 2: "RuntimeError", 3: None, 4: None}
    asked = spark.sparkContext.accumulator(0)

    def better(question):
        asked.add(1)
        return GOOD

    done = teacher.teach(rows, better, path, every=7)
    assert done.where("failure is null").count() == len(names) and asked.value == len(names) - 3  # the three that worked aren't asked again
    matrix = {r.id: (r.rated, r.maintenance) for r in teacher.label_matrix(spark.range(30), done).collect()}
    assert matrix[0] == (True, 50.0) and matrix[29] == (False, None)
    with_gaps = spark.createDataFrame([(1, 2.0, 4.0), (2, None, 3.0), (3, None, None)], "id long, a double, b double")
    assert [r.composite for r in teacher.composite(with_gaps, ["a", "b"]).orderBy("id").collect()] == [3.0, 3.0, None]
    assert teacher.composite(with_gaps, []).where("composite is not null").count() == 0


def test_judging_is_paced_by_the_limit_and_free_where_nothing_is_billed():
    assert teacher.estimate(4000, 3500, 40, 8) == {"rows": 4000, "tokens_in": 7600000, "tokens_out": 480000, "cost": 0.0, "minutes": 100.0}
    assert teacher.estimate(960, 0, 0, 8, 1.0, 10.0) == {"rows": 960, "tokens_in": 864000, "tokens_out": 115200, "cost": 2.02, "minutes": 2.0}


def test_pages_are_fetched_by_25_and_a_failed_question_is_skipped(spark):
    seen = spark.sparkContext.accumulator(0)

    def post(question):
        seen.add(1)
        if "broken" in question:
            raise ConnectionError
        names = [part.split('"')[1] for part in question.split("name: ")[1:]]
        return {f"r{i}": ({"page": {"text": f"page of {n}"}} if n != "none" else None) for i, n in enumerate(names)}

    wanted = spark.createDataFrame([(f"o/p{i}", None) for i in range(30)] + [("o/none", "docs/a.md"), (None, None), ("noslash", None)], "full_name string, path string").coalesce(1)
    got = {r.full_name: r.readme_raw for r in stores.fetch_pages(wanted, post).collect()}
    assert len(got) == 30 and got["o/p7"] == "page of p7" and seen.value == 2
    broken = spark.createDataFrame([("o/broken", None)], wanted.schema).unionByName(wanted.limit(3)).coalesce(1)
    assert stores.fetch_pages(broken, post).count() == 0
    repo = spark.createDataFrame([("O/P1", "h"), ("o/p2", None)], "full_name string, content_hash string")
    path = work_path(spark, "pages")
    assert {r.full_name for r in stores.backfill(wanted.where("full_name in ('o/p1', 'o/p2', 'o/p3')"), repo, post, path).collect()} == {"o/p2", "o/p3"}
    before = seen.value
    stores.backfill(wanted.where("full_name in ('o/p1', 'o/p2', 'o/p3')"), repo, post, path)
    assert seen.value == before


def test_a_store_is_seeded_in_batches_and_tables_are_probed(spark, tmp_path):
    rows = spark.createDataFrame([(i, struct.pack("<2f", i, 0.5)) for i in range(11)] + [(None, b""), (12, None)], "id long, v binary").coalesce(1)
    sizes, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def write(batch):
        assert len(batch) <= 4 and batch[0][1][1] == 0.5
        sizes.add(1)
        total.add(len(batch))

    stores.seed(rows, write, 4)
    assert (sizes.value, total.value) == (3, 11)
    stores.seed_folder(rows, f"file://{tmp_path}/t.parquet")
    assert stores.seed_folder(rows.limit(2), f"file://{tmp_path}/t.parquet").count() == 2
    columns, sample = stores.probe(spark, f"file://{tmp_path}/t.parquet", 1)
    assert [tuple(r)[:2] for r in columns.collect()] == [("id", "bigint"), ("v", "binary")] and len(sample) == 1
    assert [(r.table, r.bytes > 0) for r in stores.sizes(spark, f"file://{tmp_path}").collect()] == [("t", True)]
    names = stores.names_table(spark.createDataFrame([("A/b ",), ("a/B",), ("",), (None,)], "full_name string"), "some_names")
    assert [r[0] for r in names.collect()] == ["a/b"] and spark.table("some_names").count() == 1


def test_of_many_callers_one_makes_the_answer():
    made = []
    flight = serving.SingleFlight(serving.Kept(60), pause=0.005)

    def make():
        made.append(1)
        return 7

    got = []
    threads = [threading.Thread(target=lambda: got.append(flight.get("k", make))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [7] * 8 and len(made) == 1
    with pytest.raises(ZeroDivisionError):
        flight.get("other", lambda: 1 / 0)
    assert flight.get("other", lambda: 2) == 2  # the failed caller let go
    now = [0.0]
    locks = serving.Locks(lambda: now[0])
    assert locks.add("a", 5) and not locks.add("a", 5)
    now[0] = 6.0
    assert locks.add("a", 5)  # the first caller's time is up


def test_text_is_cut_at_any_sentence_end():
    for end in ("! ", "? ", ".\n", ". "):
        assert T.truncate("x" * 70 + end + "y" * 50, 100) == "x" * 70 + end[0]


def test_a_link_dump_goes_with_the_sections_under_it():
    links = "\n".join(f"- [l{i}](http://x/{i})" for i in range(4))
    page = f"## Tool\n\nIt reads files fast and well.\n\n## Friends\n\n{links}\n\n### Others\n\n{links}\n\n## Use\n\nCall it with a path."
    got = T.clean_readme(page)
    assert "Others" not in got.clean_text and "l1" not in got.clean_text and "Call it with a path." in got.clean_text and got.dropped == ["friends"]


def test_a_basis_is_put_to_other_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.1, 0.1, 0.1]) + 2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    basis = vectors.Basis.fit(df, "v", 6, 3)
    again = vectors.Basis.from_json(basis.to_json())
    got = {r.id: r.v for r in again.reduce(df, "v").collect()}
    assert got[999] is None and np.allclose([got[i] for i in range(200)], (x - x.mean(0)) @ basis.axes.T)
    assert np.var([got[i] for i in range(200)], axis=0).sum() > 0.99 * np.var(x, axis=0).sum()


def test_pages_cleaned_again_change_all_that_is_made_of_them(spark):
    schema = "id long, full_name string, readme_raw string, clean_text string, low_signal boolean, non_english boolean, clean_reduction double, dropped_sections array<string>, embedding_input string, content_hash string, stars int"
    repo = spark.createDataFrame([(1, "O/Tool", "old", "old", True, None, None, None, "old", "h", 5), (2, "o/rest", "keep", "keep", None, None, None, None, "keep", "k", 6)], schema)
    pages = spark.createDataFrame([("o/tool", "# Tool\n\nIt reads **large** files."), ("o/tool", "# Tool"), ("o/rest", "  "), ("o/unknown", "x")], "full_name string, readme_raw string")
    rows = {r.id: r for r in mutation.recleaned(repo, pages).collect()}
    assert len(rows) == 2 and rows[2].clean_text == "keep" and rows[2].content_hash == "k" and rows[1].stars == 5
    assert rows[1].readme_raw.startswith("# Tool\n") and "large files" in rows[1].clean_text and rows[1].embedding_input.startswith("Tool\n") and len(rows[1].content_hash) == 64


def test_communities_are_grouped_by_place(spark):
    world = spark.createDataFrame([(i, 1.0 + (i % 2) * 0.8 + i * 1e-4, 2.0) for i in range(40)], "repo_id long, theta double, phi double")
    labels = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, label long")
    got = {r.label: r.domain for r in sphere.community_domains(world, labels, 2).collect()}
    assert got[0] == got[2] != got[1] == got[3]


def test_noise_takes_the_nearest_centre(spark):
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 3)))
    points, centres = unit(300), unit(7)
    got = density.nearest_centres(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "repo_id long, x double, y double, z double"), spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(centres)], "c long, mx double, my double, mz double"), 0.02)
    assert {r.repo_id: r.near for r in got.collect()} == dict(enumerate((points @ centres.T).argmax(1).tolist()))
    assert density.nearest_centres(spark.range(1).selectExpr("id as repo_id", "1D as x", "0D as y", "0D as z"), spark.createDataFrame([], "c long, mx double, my double, mz double"), 0.5).count() == 0


def test_order_and_prefix_sums_over_tasks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 50 == 0 else float(rng.integers(0, 4))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    got = [r.id for r in ordering.global_positions(df, "v", F.col("id")).orderBy("position").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    counts = spark.createDataFrame([(g, float(v), v + 1) for g in "ab" for v in range(60)], "g string, v double, n long").repartition(5)
    sums = {(r.g, r.v): (r.before, r["all"]) for r in ordering.prefix_sums(counts, "g", "v").collect()}
    assert sums["a", 10.0] == (55, 1830) and len(sums) == 120


def test_a_released_step_is_gone(spark):
    step = materialise(spark.range(5), "step")
    assert step.count() == 5
    release(step)
    release(spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(step.work_path).count()


def test_faults_of_a_graph_are_named():
    entry = lambda out, w: (out << 15) | w
    good = tiles.decode_graph(tiles.encode_graph(np.array([0.6, 0.4]), np.array([0, 1, 2]), np.array([1, 0]), np.array([0, 1]), np.array([entry(1, 5), entry(0, 5)])))
    assert all(tiles.graph_facts(good).values())
    bad = tiles.decode_graph(tiles.encode_graph(np.array([0.2, 0.4]), np.array([0, 1, 2]), np.array([1, 1]), np.array([0, 1]), np.array([entry(1, 5), entry(1, 5)])))
    assert {k for k, ok in tiles.graph_facts(bad).items() if not ok} >= {"ranks sum to 1", "ranks don't rise", "no loops", "each entry has its mirror", "as many in as out"}


def test_a_graph_file_is_put_together_from_parts(spark, monkeypatch):
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b), int(k)) for a, b, k in zip(rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.integers(0, 3, 900))} | {(7, i, 0) for i in range(60)})  # 7 is in more parts than one
    links = [(a, b, k, (a * 60 + b) / 3600) for a, b, k in pairs]
    order = rng.permutation(60)  # the id at each position
    row = {int(i): p for p, i in enumerate(order)}
    want = sorted((s, t, int(w * 8191) | k << 13 | o << 15) for a, b, k, w in links if a != b for s, t, o in ((row[a], row[b], 1), (row[b], row[a], 0)))
    rank = np.linspace(2, 1, 60) / 90
    offsets = np.searchsorted([e[0] for e in want], np.arange(61))
    whole = tiles.encode_graph(rank, offsets, np.array([e[1] for e in want]), np.array([row[1], row[2], row[3], row[4]]), np.array([e[2] for e in want]))
    ordered = spark.createDataFrame([(int(i), float(rank[p]), p + 1) for p, i in enumerate(order)], "id long, rank double, position long")
    edges, arcs = spark.createDataFrame(links, "src long, dst long, kind int, weight double"), spark.createDataFrame([(3, 4, 0.5), (1, 2, 0.9)], "src long, dst long, score double")
    monkeypatch.setattr(DataFrame, "toPandas", lambda *_: pytest.fail("the whole table on the driver"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert tiles.graph_file(ordered, edges, arcs) == whole
        bare = tiles.decode_graph(tiles.graph_file(ordered, edges.limit(0), arcs.limit(0)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(bare["targets"]) == 0 and not bare["offsets"].any() and all(tiles.graph_facts(bare).values())
    with pytest.raises(tiles.TooLarge):
        tiles.graph_file(ordered, edges, arcs, most_entries=10)


def test_facts_of_a_graph_hold_blocks_only(monkeypatch):
    import tracemalloc

    n, e = 40_000, 1_000_000  # a ring where each node is joined with the 25 after it
    at = np.arange(n)
    src, dst = np.repeat(at, 25), (np.repeat(at, 25) + np.tile(np.arange(1, 26), n)) % n
    row, target, packed = np.r_[src, dst], np.r_[dst, src], np.r_[np.full(e, 32768 + 9), np.full(e, 9)]
    order = np.lexsort((packed, target, row))
    target, packed = target[order], packed[order]
    encode = lambda t, p: tiles.decode_graph(tiles.encode_graph(np.full(n, 1 / n) * np.linspace(1.9, 0.1, n), np.arange(n + 1) * 50, t, np.array([0, 1]), p))
    good = encode(target, packed)
    monkeypatch.setattr(tiles, "BLOCK", 1 << 16, raising=False)
    tracemalloc.start()
    facts = tiles.graph_facts(good)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(facts.values()) and peak < 40e6
    for place, change, fault in ((3, lambda t, p: (t, p ^ 32768), "each entry has its mirror"), (999_999, lambda t, p: (t + 1, p), "each entry has its mirror"), (5, lambda t, p: (0, p), "no loops"), (60, lambda t, p: (n + 5, p), "ends are nodes"), (7, lambda t, p: (target[6], packed[6]), "no entry twice")):
        t, p = target.copy(), packed.copy()
        t[place], p[place] = change(t[place], p[place])
        assert not tiles.graph_facts(encode(t, p))[fault], fault
    crossed = dict(good, offsets=np.r_[0, 70, 60, good["offsets"][3:]].astype("<u4"))
    assert not tiles.graph_facts(crossed)["offsets don't fall"]


def test_orphans_are_adopted_exactly_or_through_an_index(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist(), f"g{i % 5}") for i in range(300)] + [(900, None, "none")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    orphans, anchors = df.where("id % 10 = 0"), df.where("id % 10 <> 0")
    exact = {r.id: r.label for r in vectors.adopt(orphans, anchors, "id", "v", "label").collect()}
    assert set(exact) == set(range(0, 300, 10))
    index = vectors.ListIndex(anchors, "id", "v", probes=1000)
    assert len(index.centres) == round(anchors.count() ** 0.5)
    through = {r.id: r.label for r in vectors.adopt(orphans, anchors, "id", "v", "label", index).collect()}
    assert through == exact  # all lists are looked into

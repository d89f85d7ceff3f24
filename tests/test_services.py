from __future__ import annotations

import json
import random
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratlas import cli
from stratlas.functions.register import register
from stratlas.operators import density, planning
from stratlas.operators.ordering import quantiles
from stratlas.serving import Kept, Server
from stratlas.session import read
from stratlas.sources import clients
from stratlas.streaming import stars


def test_page_sizes_follow_the_server():
    p = clients.PageSize(50)
    assert [p.failed() for _ in range(5)] == [25, 12, 6, 5, 5]
    assert [p.worked() for _ in range(6)] == [5, 5, 5, 5, 10, 10]


def test_pages_survive_failures_and_end():
    answers = iter([ConnectionError(), (["a"] * 3, "c1"), (["b"] * 2, None)])

    def fetch(query, size, cursor):
        value = next(answers)
        if isinstance(value, Exception):
            raise value
        return value

    assert [(len(n), c) for n, c in clients.pages(fetch, "q")] == [(3, "c1"), (2, None)]


def test_tokens_rest_until_they_reset():
    now, slept = [0.0], []
    pool = clients.TokenPool(["a", "b"], clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    pool.seen("a", 50, 30.0)
    assert [pool.take(), pool.take()] == ["b", "b"]
    pool.seen("b", 0, 20.0)
    assert pool.take() == "b" and slept == [20.0]
    with pytest.raises(ValueError):
        clients.TokenPool([]).take()


def test_rate_and_retries():
    now, slept = [0.0], []
    rate = clients.RateLimiter(2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        rate.wait()
    assert slept == [60.0]
    calls = iter([ConnectionError(), TimeoutError(), 7])

    def call():
        value = next(calls)
        if isinstance(value, Exception):
            raise value
        return value

    assert clients.with_retries(call, sleep=lambda s: None) == 7
    with pytest.raises(ConnectionError):
        clients.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), tries=2, sleep=lambda s: None)


def test_captured_search_reads_a_partition_a_query(spark, tmp_path):
    node = {"nameWithOwner": "o/a", "stargazerCount": 5, "pushedAt": "2025-01-02T03:04:05Z", "repositoryTopics": {"nodes": [{"topic": {"name": "x"}}]}, "primaryLanguage": None}
    (tmp_path / (quote("stars:1..5", safe="") + ".jsonl")).write_text(json.dumps(node) + "\n\n")
    (tmp_path / (quote("stars:6..9", safe="") + ".jsonl")).write_text(json.dumps(node) + "\n" + json.dumps({"nameWithOwner": "o/b", "pushedAt": "never"}) + "\n")
    rows = clients.captured_search(spark, str(tmp_path), ["stars:1..5", "stars:6..9", "stars:10..20"]).orderBy("full_name").collect()
    assert [(r.full_name, r.stars, r.topics) for r in rows] == [("o/a", 5, ["x"]), ("o/b", None, [])] and rows[1].pushed_at is None


def test_embedding_checks_the_answer(spark):
    df = spark.createDataFrame([(1, "fast parser"), (2, "  "), (3, None)], "id long, t string")
    rows = clients.embed(df, "id", "t", 16).collect()
    assert [r.id for r in rows] == [1] and abs(np.linalg.norm(rows[0].v) - 1) < 1e-6
    with pytest.raises(PySparkException):
        clients.embed(df, "id", "t", 16, client=lambda texts: []).collect()


def test_shards_cover_the_range_and_verdicts():
    shards = planning.star_shards()
    assert shards[0][0] == 50 and shards[-1][1] == 400_000 and all(b[0] == a[1] + 1 for a, b in zip(shards, shards[1:]))
    assert planning.parse_shard(planning.shard_query(5, 9, "go")) == (5, 9, "go")
    with pytest.raises(ValueError):
        planning.parse_shard("stars:9..5")
    assert planning.plan_for_target(1500, [((1, 2), 5000), ((3, 4), 900), ((5, 6), 100)]) == [(5, 6), (3, 4), (1, 2)]
    assert planning.next_step({}) == "ingest" and planning.next_step({"repo": 10, "clean": 10}) == "embed"
    assert planning.assess_coverage(0.1, 0.5, 0.9, 1000) and not planning.assess_coverage(0.1, 0.5, 0.9, 50)


def test_doctor(spark):
    made = lambda rows: spark.createDataFrame(rows, "cursor string, rows long, done boolean")
    assert planning.doctor(made([(None, 100, True)]), 100) == "COMPLETE"
    assert planning.doctor(made([("c", 5, False)]), 100) == "INTERRUPTED"
    assert planning.doctor(made([(None, 5, True)]), 100) == "PLAN EXHAUSTED"
    assert planning.doctor(made([(None, 0, False)]), 100) == "IN PROGRESS"


@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles_are_exact(spark, discrete):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, float("nan"), 0.0, 0.0, 0.0, rng.gauss(0, 9)])) for _ in range(700)]
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, F.col("k"), discrete).collect()}
    for key in "ab":
        values = np.array([v for k, v in rows if k == key and v is not None and v == v])
        assert np.allclose(got[key], np.quantile(values, shares, method="inverted_cdf" if discrete else "linear"))
    assert quantiles(spark.createDataFrame([], "k string, v double"), "v", [0.5]).collect() == []


def test_density_clusters_and_their_noise(spark):
    rng = random.Random(7)
    rows = [(i, 1.0 + rng.gauss(0, 0.01), 1.0 + rng.gauss(0, 0.01)) for i in range(200)] + [(1000 + i, 2.0 + rng.gauss(0, 0.01), 4.0 + rng.gauss(0, 0.01)) for i in range(200)] + [(5000, 1.2, 1.1), (5001, None, 1.0)]
    got = {r.repo_id: (r.cluster_id, r.is_noise) for r in density.density_clusters(spark.createDataFrame(rows, "repo_id long, theta double, phi double")).collect()}
    near = {c for i, (c, n) in got.items() if i < 200 and not n}
    far = {c for i, (c, n) in got.items() if 1000 <= i < 2000 and not n}
    assert len(near) == len(far) == 1 and near != far and got[5000] == (near.pop(), True) and 5001 not in got
    assert density.density_clusters(spark.createDataFrame([], "repo_id long, theta double, phi double")).collect() == []


def test_sql_names(spark):
    register(spark)
    row = spark.sql("select clean_readme('# A\n\nsome text here', null) as c, parse_judgement('{}') as j, heading_key('## [Use](x)!') as k").first()
    assert row.c.clean_text.startswith("A") and row.j.maintenance is None and row.k == "use"
    assert {tuple(r) for r in spark.sql("select p.* from pairs(array('b', 'a', 'b', null)) p").collect()} == {("a", "b")}


def test_the_server_answers(spark, data):
    repo, edge = read(spark, data, "repo"), read(spark, data, "edge")
    server = Server(repo, edge)
    rows, arms = server.search("pogolopeva", 5)
    assert rows[0]["full_name"].endswith("/pogolopeva") and arms == "name+text" and server.search("Pogolopeva ", 5)[0] == rows
    for bad in (("a", 5), ("abc", 0), ("abc", 101)):
        with pytest.raises(ValueError):
            server.search(*bad)
    assert server.page(name=rows[0]["full_name"].upper())["id"] == rows[0]["id"] and server.page(name="no/such", id_=rows[0]["id"]) is None
    around = server.graph(rows[0]["id"])
    assert rows[0]["id"] in around["nodes"] and all(rows[0]["id"] in (e["src"], e["dst"]) for e in around["edges"])
    assert server.graph(-1) == {"nodes": [-1], "edges": []}


def test_answers_age():
    now = [0.0]
    kept = Kept(10, 2, clock=lambda: now[0])
    made = []
    for t in (0, 5, 11):
        now[0] = t
        kept.get("k", lambda: made.append(1))
    assert len(made) == 2


def test_commands_have_their_queries(data, capsys, spark):
    from stratlas.plans.catalogue import QUERIES

    assert set(cli.COMMANDS.values()) <= set(QUERIES)
    with pytest.raises(SystemExit):
        cli.main(["nonsense", data])


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    for ignore, want in ((False, {1: 4.0, 2: 1.0, 3: 3.0}), (True, {1: 1.0, 2: 1.0, 3: 2.0})):
        path = f"file://{tmp_path}/t{ignore}"
        sink = stars.upserting(path, ["id"], ignore, ["n"], most_parts=2)
        batches = [[(1, 1.0, "x"), (2, 1.0, "x")], [(1, 2.0, "x"), (1, 3.0, None)], [(3, 2.0, "x"), (3, 3.0, "x")], [(1, 4.0, "x")], [(2, 0.5, None), (2, 1.0, None)], [(1, 4.0, "x")]]
        for n, rows in enumerate(batches):
            batch = spark.createDataFrame(rows, "id long, n double, s string")
            sink(batch, n)
            sink(batch, n)
            sink(spark.createDataFrame([(9, 9.0, "never")], batch.schema), max(0, n - 3))  # one that came before comes again
        assert {r.id: r.n for r in stars.upserted(spark, path, ["id"], ignore).collect()} == want
        assert {n for f, n in stars._names(spark, path) if f == "base"} == {"0000000002", "0000000004"}


def test_late_rows_do_not_count_in_closed_windows(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    row = lambda i, day: f"({i}, timestamp_ntz '2024-01-{day:02d} 00:00:00', 1, 'x', 1.0, '')"
    (tmp_path / "e").mkdir()
    rows = stars.velocity(stars.event_stream(spark, path), "event_type", "1 day", late="1 day")
    query = rows.writeStream.outputMode("append").format("memory").queryName("late").start()
    try:
        for i, day in enumerate((1, 10, 2, 20)):
            spark.sql(f"select * from values {row(i, day)} as t(event_id, ts, user_id, event_type, value, props)").selectExpr("bigint(event_id) event_id", "ts", "bigint(user_id) user_id", "event_type", "double(value) value", "props").write.mode("append").parquet(path)
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(str(r.start)[:10] for r in spark.table("late").collect()) == ["2024-01-01", "2024-01-10"]


def test_sessions_of_events(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    spark.sql("select bigint(id) event_id, timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id / 3) * 5, int(id % 3) * 10, 0) ts, bigint(1) user_id, 'x' event_type, double(1) value, '' props from range(9)").coalesce(1).write.parquet(path)  # one file, so one batch
    out = stars.run_to_end(stars.sessions(stars.event_stream(spark, path), "user_id", late="10 minutes"), "sessions", "append")
    assert {r.n for r in out.collect()} == {3} and out.count() >= 2


def test_vector_tables_resume(spark):
    have = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>")
    rows = spark.createDataFrame([(1, "a"), (2, "b c")], "id long, t string")
    left = clients.not_yet_embedded(rows, have)
    assert [r.id for r in left.collect()] == [2]
    assert {r.id for r in clients.extend_vectors(have, clients.embed(left, "id", "t", 2), 2).collect()} == {1, 2}
    with pytest.raises(PySparkException):
        clients.extend_vectors(have, spark.createDataFrame([(3, [1.0])], "id long, v array<float>"), 2).collect()

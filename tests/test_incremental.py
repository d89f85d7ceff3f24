from __future__ import annotations

import datetime as dt
import random

import pytest

from stratlas.operators import incremental
from stratlas.operators.incremental import Overtaken, StateStore, records, replay, run_once
from stratlas.session import work_path

LANDING = "fetch_id long, repo_id long, fetched_at timestamp_ntz, landed_at timestamp_ntz, embedding_input string, readme_raw string, landed string"
RUN = "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
DAY = dt.datetime(2025, 1, 1)


def at(hours):
    return None if hours is None else DAY + dt.timedelta(hours=hours)


def brute(landings, runs):
    state, out = {}, []
    for run_id, started, _, status in sorted((r for r in runs if r[1]), key=lambda r: r[1]):
        if status != "ok":
            continue
        latest = {}
        for f, k, fetched, landed, a, b, _ in landings:
            if k is None or landed is None or landed > started:
                continue
            order = (fetched or dt.datetime.min, f)
            if k not in latest or order > latest[k][0]:
                latest[k] = (order, (a, b))
        for k, (_, content) in latest.items():
            if state.get(k) != content:
                out.append((run_id, k))
                state[k] = content
    return sorted(out)


def test_random_landings_match_brute_force(spark):
    rng = random.Random(4)
    landings = []
    for f in range(160):
        fetched = rng.choice([None, *range(50)]) if rng.random() < 0.05 else rng.randrange(50)
        row = (f, rng.choice([None, *range(12)]), at(fetched), at(rng.choice([None, *range(60)])), rng.choice([None, "", "a", "b", "-"]), rng.choice([None, "", "x", "y"]), "clash")
        landings += [row] * rng.choice([1, 1, 1, 2])
    runs = [(i, at(h), None, s) for i, (h, s) in enumerate([(5, "ok"), (9, "failed"), (15, "ok"), (20, None), (30, "ok"), (31, "ok"), (60, "ok"), (None, "ok")])]
    got = replay(spark.createDataFrame(landings, LANDING), spark.createDataFrame(runs, RUN))
    assert sorted((r.run_id, r.repo_id) for r in got.collect()) == brute(landings, runs)


def test_null_is_a_value_and_fields_do_not_run_together(spark):
    rows = [(1, 1, at(1), at(1), None, "x", ""), (2, 1, at(2), at(2), "", "x", ""), (3, 1, at(3), at(3), "x", "", "")]
    runs = [(i, at(i), None, "ok") for i in (1, 2, 3)]
    got = replay(spark.createDataFrame(rows, LANDING), spark.createDataFrame(runs, RUN))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1), (3, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], LANDING)
    assert replay(none, spark.createDataFrame([], RUN)).collect() == []
    assert replay(none, spark.createDataFrame([(1, at(1), None, "ok")], RUN)).collect() == []


def test_a_run_that_dies_before_the_swap_is_repeated(spark):
    store = StateStore(spark, work_path(spark, "state"))
    rows = spark.createDataFrame([(1, 7, at(1), at(1), "a", None, "")], LANDING)
    first = run_once(store, rows, "2025-01-01 02:00:00")
    assert first.rows.count() == 1
    again = run_once(StateStore(spark, store.path), rows, "2025-01-01 02:00:00")  # the first was never committed
    assert [r.key for r in again.rows.collect()] == [7]
    store.swap(again, "2025-01-01 02:00:00")
    assert store.current() == (1, "2025-01-01 02:00:00")
    assert run_once(store, rows, "2025-01-01 03:00:00").rows.count() == 0


@pytest.mark.parametrize("late", [0, 1])
def test_older_content_that_lands_late_changes_nothing(spark, late):
    rows = [(1, 1, at(5), at(5), "new", None, ""), (2, 1, at(4), at(8), "old", None, "")][: 1 + late]
    got = replay(spark.createDataFrame(rows, LANDING), spark.createDataFrame([(1, at(6), None, "ok"), (2, at(9), None, "ok")], RUN))
    assert [tuple(r) for r in got.collect()] == [(1, 1)]


def test_of_two_runs_at_once_one_fails(spark):
    store = StateStore(spark, work_path(spark, "state"))
    rows = spark.createDataFrame([(1, 7, at(1), at(1), "a", None, "x"), (1, 7, at(1), at(2), "a", None, "y"), (2, 8, at(1), at(1), None, None, "z"), (3, 8, at(1), at(9), None, "later", "z")], LANDING)
    one, two = run_once(store, rows, "2025-01-01 02:00:00"), run_once(store, rows, "2025-01-01 02:00:00")
    assert sorted((r.repo_id, r.embedding_input, r.readme_raw) for r in records(rows, one).collect()) == [(7, "a", None), (8, None, None)]
    store.swap(one, "2025-01-01 02:00:00")
    with pytest.raises(Overtaken):
        store.swap(two, "2025-01-01 02:00:00")
    assert store.current()[0] == 1
    store.vacuum()  # what the loser wrote goes, the state stays
    assert {r.key for r in store.read(store.manifest()).collect()} == {7, 8}
    assert [r.key for r in run_once(store, rows, "2025-01-01 10:00:00").rows.collect()] == [8]


def test_a_run_writes_its_changes_and_bases_are_renewed(spark, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_PARTS", 3)
    store = StateStore(spark, work_path(spark, "state"))
    rows = [(i, i, at(1), at(1), "a", None, "") for i in range(100)] + [(1000 + h, h, at(h), at(h), f"b{h}", None, "") for h in range(2, 9)]
    landings = spark.createDataFrame(rows, LANDING)
    kinds = []
    for h in range(1, 9):
        take = run_once(store, landings, f"2025-01-01 0{h}:00:00")
        assert take.rows.count() == (100 if h == 1 else 1)
        store.swap(take, f"2025-01-01 0{h}:00:00")
        kinds.append((len(take.manifest.parts), take.manifest.sizes[-1]))
    assert kinds[:4] == [(1, 100), (2, 1), (3, 1), (1, 100)]
    assert store.read(store.manifest()).where("hash is not null").count() == 100
    store.vacuum()
    assert store.read(store.manifest()).count() == 100 and run_once(store, landings, "2025-01-01 09:00:00").rows.count() == 0

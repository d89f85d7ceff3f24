from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratlas.operators import graph as G
from stratlas.sources import synthetic


def test_a_world_is_the_same_on_every_run(spark):
    a, b = synthetic.world(spark, 500), synthetic.world(spark, 500).repartition(3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    r = a.agg(F.min("theta"), F.max("theta"), F.min("phi"), F.max("phi"), F.count_distinct("domain"), F.max("stars")).first()
    assert 0 <= r[0] <= r[1] <= math.pi and 0 <= r[2] <= r[3] < 2 * math.pi and r[4] == 12 and r[5] > 100
    assert synthetic.world(spark, 0).collect() == []


def test_early_records_attract_edges(spark):
    e = synthetic.edges(spark, 2000)
    n = {r.dst: r["count"] for r in e.groupBy("dst").count().collect()}
    assert e.where("src <= dst").count() == 0 and sum(n.get(i, 0) for i in range(100)) > 5 * sum(n.get(i, 0) for i in range(1900, 2000))
    ranks = G.pagerank(spark.range(2000), e, tolerance=1e-6).agg(F.sum("rank"), F.max("rank") / F.avg("rank")).first()
    assert abs(ranks[0] - 1) < 1e-6 and ranks[1] > 10

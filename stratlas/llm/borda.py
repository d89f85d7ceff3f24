"""One ranking from several differently-scaled scores: a weighted Borda count (problem 3).

No stage sorts all rows in one task, and no join key is hotter than a bound: each score is first reduced to its
distinct values with counts (partial aggregation on the map side), and the values are ranked by prefix sums over tasks. Values that hold more than 1/``HOT`` of all rows are
fewer than ``HOT`` per score; only these travel by broadcast, all others by a join on the value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.operators.ordering import prefix_sums
from stratlas.session import materialise

HOT = 256
SIGNALS = ("stars", "dependents", "pagerank_ratio", "stars_90d")


def long_scores(scores: DataFrame, id_col: str, signals: dict[str, float]) -> DataFrame:
    """``(id, signal, value)``, a row per record and signal; NaN counts as missing, -0.0 as 0.0.

    Repeated rows of an id are one record, with its largest value of each score; a null id is no record.
    """
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double") + 0.0)).alias(s) for s in signals]
    one = scores.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*clean)
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in signals])
    return one.select("id", F.inline(pairs))


def value_points(long: DataFrame, signals: dict[str, float]) -> DataFrame:
    """``(signal, value, n, points)`` of each distinct value: records below it plus half of those level with it.

    Missing scores (value null) take the mid-rank of all records, as if tied with everyone.
    """
    counts = long.groupBy("signal", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "borda-values")
    ranked = prefix_sums(counts.where("value is not null"), "signal", "value")
    ranked = ranked.select("signal", "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("points"), "all")
    present = ranked.groupBy("signal").agg(F.max("all").alias("ranked_n"))  # a row per score
    missing = counts.where("value is null").join(F.broadcast(present), "signal", "left")
    missing = missing.select("signal", "value", "n", ((F.coalesce("ranked_n", F.lit(0)) + 1) / 2).alias("points"))
    return ranked.drop("all").unionByName(missing)


def borda_points(scores: DataFrame, id_col: str = "repo_id", signals: dict[str, float] | tuple[str, ...] = SIGNALS) -> DataFrame:
    """``(id, points)``: weighted sum of each record's points in each score; higher is better.

    Competition ranks with averaged ties per score, counted from the low end: each score adds between 1 and the
    number of records that have it, times its weight, however wide its range. Points are exact multiples of
    one half, so the order of additions doesn't matter. An empty table gives an empty table.
    """
    weights = dict.fromkeys(signals, 1.0) if not isinstance(signals, dict) else signals
    long = long_scores(scores, id_col, weights)
    points = value_points(long, weights)
    total = points.groupBy("signal").agg(F.sum("n").alias("records"))
    points = points.join(F.broadcast(total), "signal").withColumn("hot", F.col("n") * HOT > F.col("records"))
    points = points.select("signal", "value", "points", "hot")
    # at most HOT values of a score can be hot, and a null value is always sent this way
    few = points.where("hot or value is null").select("signal", F.col("value").alias("v"), "points")
    most = points.where("not hot and value is not null").select("signal", "value", "points")
    marked = long.join(
        F.broadcast(few.withColumnRenamed("points", "hot_points").withColumnRenamed("signal", "s")),
        (F.col("signal") == F.col("s")) & F.col("value").eqNullSafe(F.col("v")),
        "left",
    ).select("id", "signal", "value", "hot_points")
    hot = marked.where("hot_points is not null").select("id", "signal", F.col("hot_points").alias("points"))
    cold = marked.where("hot_points is null").select("id", "signal", "value").join(most, ["signal", "value"])
    both = hot.unionByName(cold.select("id", "signal", "points"))
    weight = reduce(lambda c, s: c.when(F.col("signal") == s, F.lit(float(weights[s]))), list(weights)[1:], F.when(F.col("signal") == list(weights)[0], F.lit(float(weights[list(weights)[0]]))))
    return both.groupBy("id").agg(F.sum(F.col("points") * weight).alias("points"))


def higher_of(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """``(repo_a, repo_b, higher_id)``: which of two records stands higher; ties go to the smaller id.

    Pairs with a record that has no points, or a null id, give no row; repeated pairs give one.
    """
    ids = pairs.select(F.explode(F.array("repo_a", "repo_b")).alias("id")).distinct()
    points = materialise(points.join(ids, "id", "left_semi"), "borda-points")  # read twice, made once
    a = points.select(F.col("id").alias("repo_a"), F.col("points").alias("pa"))
    b = points.select(F.col("id").alias("repo_b"), F.col("points").alias("pb"))
    both = pairs.select("repo_a", "repo_b").distinct().join(a, "repo_a").join(b, "repo_b")
    smaller: Column = F.least("repo_a", "repo_b")
    higher = F.when(F.col("pa") > F.col("pb"), F.col("repo_a")).when(F.col("pb") > F.col("pa"), F.col("repo_b")).otherwise(smaller)
    return both.select("repo_a", "repo_b", higher.alias("higher_id"))

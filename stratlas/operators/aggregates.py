"""Reports and statistics: partial aggregation throughout, nothing gathered by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.operators.ordering import quantiles


def quality_report(repo: DataFrame) -> DataFrame:
    """One row: how much of the catalogue has text, and how good it is."""
    text = F.coalesce(F.length("clean_text"), F.lit(0)) > 0
    return repo.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(text).alias("with_text"), F.count_if(F.col("low_signal")).alias("low_signal"),
        F.count_if(F.col("non_english")).alias("non_english"), F.count_if(F.coalesce(F.length("readme_raw"), F.lit(0)) == 0).alias("no_readme"),
        F.count_if(F.col("is_fork")).alias("forks"), F.round(F.avg("clean_reduction"), 3).alias("avg_reduction"),
    )


def quality_verdict(report: DataFrame) -> DataFrame:
    """Whether the catalogue meets the exit criteria: at least 90 % text, under 25 % low signal, reduction over 0.35."""
    total = F.greatest(F.col("total"), F.lit(1))
    return report.select("*", ((F.col("with_text") / total >= 0.9) & (F.col("low_signal") / total < 0.25) & (F.col("avg_reduction") > 0.35)).alias("passes"))


def star_distribution(repo: DataFrame) -> DataFrame:
    """Smallest, largest and discrete median stars, and how many reach each threshold."""
    at_least = [F.count_if(F.col("stars") >= t).alias(f"ge_{t}") for t in (10, 100, 1000, 10000)]
    one = repo.agg(F.lit("").alias("g"), F.min("stars").alias("min_stars"), F.max("stars").alias("max_stars"), *at_least)
    middle = quantiles(repo, "stars", [0.5], discrete=True).select("g", F.col("q")[0].cast("long").alias("median_stars"))
    return one.join(F.broadcast(middle), "g", "left").drop("g")


def top_values(rows: DataFrame, column: str, k: int, none: str = "(none)") -> DataFrame:
    """The ``k`` most frequent values; null and empty count as ``none``; ties by value."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(none))
    return rows.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def histogram(rows: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """Rows per bucket 1…``buckets``; values below ``low`` are in 0, from ``high`` on in ``buckets``+1; null and NaN in none."""
    value = F.col(column).cast("double")
    bucket = F.expr(f"width_bucket(`{column}`, {low}D, {high}D, {buckets})")
    return rows.where(value.isNotNull() & ~F.isnan(value)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def edges_by_kind(edge: DataFrame) -> DataFrame:
    """Edges, distinct edges and weight per kind."""
    return edge.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("weight").isNull()).alias("no_weight"))


def linked_nodes(edge: DataFrame) -> DataFrame:
    """How many nodes stand at either end of an edge."""
    return edge.select(F.col("src").alias("id")).union(edge.select("dst")).distinct().agg(F.count(F.lit(1)).alias("nodes"))


def star_velocity(events: DataFrame, now: str, months: int = 3) -> DataFrame:
    """Stars per repository in the trailing calendar months, the current one included (a range on the date, pushed down)."""
    first = F.add_months(F.trunc(F.lit(now).cast("date"), "month"), 1 - months)
    rows = events.where((F.col("starred_at") >= first) & (F.col("starred_at") <= F.lit(now).cast("date")))
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("stars_recent"))


def first_stars(events: DataFrame) -> DataFrame:
    """The first star of each actor for each repository; undated events count only where there is no other."""
    return events.where("actor is not null and repo_id is not null").groupBy("actor", "repo_id").agg(F.min("starred_at").alias("starred_at"))


def bounded_actors(events: DataFrame, least: int = 2, most: int = 400) -> DataFrame:
    """Actors with between ``least`` and ``most`` repositories, and how many they have."""
    return first_stars(events).groupBy("actor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))


def row_mean(columns: list[str]) -> Column:
    """Mean of a row's columns that aren't null; null if all are."""
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(known > 0, total / known)


def dependents(edge: DataFrame, kind: int = 0) -> DataFrame:
    """In-degree of one kind of edge."""
    return edge.where(F.col("kind") == kind).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))


def degrees(edge: DataFrame) -> DataFrame:
    """In- and out-degree over dependency and co-use edges, and similar edges counted at both ends."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("side")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("side")))).alias("e"), "kind")
    rows = ends.select("e.id", "e.side", "kind")
    similar = F.col("kind") == 1
    return rows.groupBy("id").agg(
        F.count_if(~similar & (F.col("side") == "in")).alias("in_degree"), F.count_if(~similar & (F.col("side") == "out")).alias("out_degree"), F.count_if(similar).alias("similar_degree")
    )


def weight_statistics(edge: DataFrame) -> DataFrame:
    """Count, smallest, median, 99th percentile and largest weight per kind (linear interpolation), rounded to 3."""
    rows = edge.where("weight is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    middle = quantiles(edge, "weight", [0.5, 0.99], F.col("kind"))  # a row per kind
    rows = rows.join(F.broadcast(middle), F.col("kind").cast("string") == F.col("g"), "left")
    return rows.select("kind", "n", F.round("lo", 3).alias("min"), F.round(F.col("q")[0], 3).alias("median"), F.round(F.col("q")[1], 3).alias("p99"), F.round("hi", 3).alias("max"))


def degree_statistics(nodes: DataFrame, degree: DataFrame, column: str) -> DataFrame:
    """Mean, median, 99th percentile, largest and number of zeros of a degree over all nodes."""
    rows = nodes.select("id").join(degree.select("id", column), "id", "left").select(F.coalesce(column, F.lit(0)).alias("d"))
    stats = rows.agg(F.lit("").alias("g"), F.avg("d").alias("m"), F.max("d").alias("hi"), F.count_if(F.col("d") == 0).alias("zero"))
    stats = stats.join(F.broadcast(quantiles(rows, "d", [0.5, 0.99])), "g", "left")
    return stats.select(F.round("m", 3).alias("mean"), F.floor(F.col("q")[0]).cast("int").alias("median"), F.floor(F.col("q")[1]).cast("int").alias("p99"), F.col("hi").cast("long").alias("max"), "zero")


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smaller value; null values count for none."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))


def coverage_grid(world: DataFrame, rows: int = 24, columns: int = 48) -> DataFrame:
    """``(ring, slot, n)`` of an equal-area grid of the sphere, empty cells included."""
    spark = world.sparkSession
    z, phi = F.cos("theta"), F.pmod(F.col("phi"), F.lit(2 * 3.141592653589793))
    ring = F.least(F.lit(rows - 1), F.floor((1 - z) / 2 * rows)).cast("int")
    slot = F.least(F.lit(columns - 1), F.floor(phi / (2 * 3.141592653589793) * columns)).cast("int")
    full = world.where("theta is not null and phi is not null").groupBy(ring.alias("ring"), slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(rows * columns).select((F.col("id") / columns).cast("int").alias("ring"), (F.col("id") % columns).cast("int").alias("slot"))
    return spine.join(full, ["ring", "slot"], "left").na.fill(0, ["n"])


def coverage(world: DataFrame, rows: int = 24, columns: int = 48) -> DataFrame:
    """Share of cells in use, Gini coefficient, largest cell's share, and empty cells; the grid has a fixed size."""
    grid = coverage_grid(world, rows, columns)
    order = W.partitionBy(F.lit(0)).orderBy("n", "ring", "slot")
    ranked = grid.withColumn("i", F.row_number().over(order))
    total = F.greatest(F.sum("n"), F.lit(1))
    cells = rows * columns
    gini = (2 * F.sum(F.col("i") * F.col("n")) / total - (cells + 1)) / cells
    return ranked.agg(
        F.round(F.count_if(F.col("n") > 0) / cells, 6).alias("occupied"), F.round(gini, 6).alias("gini"), F.round(F.max("n") / total, 6).alias("max_share"), F.count_if(F.col("n") == 0).alias("empty")
    )


def recall_at_k(expected: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of the expected names among the first ``k``, and how many queries found none of theirs."""
    top = ranked.where(F.col("position") <= k).select("query", "name").distinct()
    wanted = expected.select("query", "name").distinct().join(top.withColumn("hit", F.lit(1)), ["query", "name"], "left")
    per = wanted.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("recall"), F.count_if(F.col("r") == 0).alias("empty"), F.count(F.lit(1)).alias("queries"))


def flag_counts(rows: DataFrame, column: str) -> DataFrame:
    """How often each entry of an array column occurs."""
    return rows.select(F.explode(column).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def interval_statistics(rows: DataFrame, column: str, budget: float) -> DataFrame:
    """Nearest-rank median and 99th percentile of intervals, and how many pass ``budget``."""
    over = F.count_if(F.col(column) > budget)
    one = rows.agg(F.lit("").alias("g"), over.alias("dropped"), F.round(over / F.greatest(F.count(column), F.lit(1)), 6).alias("drop_ratio"))
    one = one.join(F.broadcast(quantiles(rows, column, [0.5, 0.99], discrete=True)), "g", "left")
    return one.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"), "dropped", "drop_ratio")


def inner_composition(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges that stay inside a community, with their weight, by kind."""
    rows = edge.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return rows.where("a = b").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6).alias("weight"))

"""Star scale, composite score, display sizes and leaderboards."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.operators.ordering import prefix_sums, quantiles

#: Rungs of the star ladder, weights of the composite, anchors of the dependents' percentile.
LADDER = (0, 1, 2, 3, 5, 8, 12, 20, 30, 50, 75, 100, 150, 250, 400, 600, 1000, 1500, 2500, 4000, 6000, 10000, 15000, 25000, 40000, 60000, 100000, 150000, 250000)
WEIGHTS = {"stars": 0.25, "dependents": 0.35, "pagerank": 0.20, "criticality": 0.10, "velocity": 0.10}
ANCHORS = ((1, 0.3), (10, 0.5), (100, 0.7), (1000, 0.85), (10000, 0.95), (100000, 1.0))
FULL_STARS = 500_000


def star_scale(repo: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """``(threshold, count)``: repositories with at least each rung's stars, from one histogram over the rungs."""
    reached = sum((F.when(F.col("stars") >= t, 1).otherwise(0) for t in ladder), F.lit(0))
    per = repo.where("stars is not null").groupBy(reached.alias("rungs")).agg(F.count(F.lit(1)).alias("n"))
    rungs = repo.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ladder)], "rung int, threshold long")
    # both sides have at most a row per rung
    rows = rungs.join(F.broadcast(per), F.col("rungs") >= F.col("rung"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    return rows


def repaired(counts: list[tuple[int, int | None]]) -> list[tuple[int, int]]:
    """A measured scale without missing, absurd (≤ 0 or ≥ 1e9) and rising rungs."""
    kept: list[tuple[int, int]] = []
    for threshold, count in sorted(counts, key=lambda x: x[0]):
        if count is None or count <= 0 or count >= 1_000_000_000 or (kept and count > kept[-1][1]):
            continue
        kept.append((threshold, count))
    return kept


def at_least(stars: Column, scale: list[tuple[int, int]]) -> Column:
    """Repositories with at least so many stars, ln-ln interpolated between the scale's rungs."""
    if not scale:
        raise ValueError("an empty star scale")
    if any(b[0] <= a[0] or b[1] > a[1] for a, b in zip(scale, scale[1:])):
        raise ValueError("thresholds must rise and counts must not")
    value: Column = F.lit(float(scale[-1][1]))
    for (t0, c0), (t1, c1) in reversed(list(zip(scale, scale[1:]))):
        if c1 <= 0:
            between: Column = F.lit(float(c0))
        else:
            along = (F.log(stars + 1) - math.log(t0 + 1)) / (math.log(t1 + 1) - math.log(t0 + 1))
            between = F.exp(math.log(c0) + along * (math.log(c1) - math.log(c0)))
        value = F.when(stars < t1, between).otherwise(value)
    return F.when(stars < scale[0][0], F.lit(float(scale[0][1]))).otherwise(value)


def star_rank(stars: Column, scale: list[tuple[int, int]]) -> Column:
    """The place among all repositories that so many stars give, 1 or more; halves go to the even number."""
    return F.greatest(F.lit(1), F.rint(at_least(stars, scale)).cast("long"))


def magnitude(stars: Column) -> Column:
    """The fourth root of the share of ``FULL_STARS``, at most 1."""
    return F.least(F.lit(1.0), F.pow(F.greatest(stars, F.lit(0)) / FULL_STARS, F.lit(0.25)))


def dependents_share(count: Column) -> Column:
    """Piecewise linear in the logarithm between the anchors; 0 for none."""
    value: Column = F.lit(ANCHORS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(ANCHORS, ANCHORS[1:]))):
        along = (F.log10(count) - math.log10(x0)) / (math.log10(x1) - math.log10(x0))
        value = F.when(count <= x1, y0 + along * (y1 - y0)).otherwise(value)
    return F.when(count <= 0, F.lit(0.0)).when(count <= 1, F.lit(ANCHORS[0][1])).otherwise(value)


def composite(rows: DataFrame, weights: dict[str, float] = WEIGHTS, digits: int = 4) -> DataFrame:
    """``(id, score, parts…)`` from stars, dependents, pagerank_ratio, criticality and stars_90d; absent signals are neutral."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    clean = lambda c, neutral: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(neutral))
    ratio = F.greatest(clean("pagerank_ratio", 1.0), F.lit(0.01))
    parts = {
        "stars": magnitude(clean("stars", 0.0)),
        "dependents": dependents_share(clean("dependents", 0.0)),
        "pagerank": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(ratio + 0.1) / 3 + 0.34)),
        "criticality": F.least(F.lit(1.0), F.greatest(F.lit(0.0), clean("criticality", 0.0))),
        "velocity": magnitude(4 * clean("stars_90d", 0.0)),
    }
    score = sum((parts[p] * w for p, w in weights.items()), F.lit(0.0)) / total * 100
    return rows.select("id", F.round(score, 2).alias("score"), *[F.round(c, digits).alias(p) for p, c in parts.items()])


def rank_ratios(ranks: DataFrame) -> DataFrame:
    """``(id, pagerank_ratio)``: rank over the mean of the positive ranks; 1 where the rank isn't positive."""
    mean = ranks.agg(F.avg(F.when(F.col("rank") > 0, F.col("rank"))).alias("mean"))
    rows = ranks.join(F.broadcast(mean), F.lit(True))
    return rows.select("id", F.when(F.col("rank") > 0, F.col("rank") / F.coalesce("mean", F.lit(1.0))).otherwise(F.lit(1.0)).alias("pagerank_ratio"))


def leaderboard(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def summary(scores: DataFrame) -> DataFrame:
    """Best, upper median and worst score."""
    one = scores.agg(F.lit("").alias("g"), F.max("score").alias("best"), F.min("score").alias("worst"), F.count("score").alias("n"))
    middle = quantiles(scores.select((-F.col("score")).alias("down")), "down", [0.5], discrete=True)
    return one.join(F.broadcast(middle), "g", "left").select("best", "worst", "n", (-F.col("q")[0]).alias("median"))


def display_sizes(ordered: DataFrame) -> DataFrame:
    """``(id, size)``: percentile by position, averaged over records tied in rank and tie-break; needs ``position``."""
    n = ordered.agg(F.count(F.lit(1)).alias("n"))
    rows = ordered.join(F.broadcast(n), F.lit(True)).withColumn("p", F.when(F.col("n") > 1, (F.col("n") - F.col("position")) / (F.col("n") - 1)).otherwise(F.lit(1.0)))
    ties = rows.groupBy("rank", "tiebreak").agg(F.avg("p").alias("size"))
    return rows.join(ties, ["rank", "tiebreak"]).select("id", "size")


def bands(ordered: DataFrame, shares: tuple[float, ...] = (0.02, 0.18)) -> DataFrame:
    """``(id, position, band)``: level-of-detail bands by position; cuts are rounded half to even, the last takes the rest."""
    n = ordered.agg(F.count(F.lit(1)).alias("n"))
    rows = ordered.join(F.broadcast(n), F.lit(True))
    band, passed = None, F.lit(0)
    for i, share in enumerate(shares):
        passed = passed + F.rint(F.col("n") * share)
        band = (F.when if band is None else band.when)(F.col("position") <= passed, F.lit(i))
    return rows.select("id", "position", band.otherwise(F.lit(len(shares))).alias("band"))


#: The display sizes of each band.
BAND_SIZES = ((0.60, 1.0), (0.36, 0.60), (0.17, 0.36))


def banded_sizes(banded: DataFrame) -> DataFrame:
    """``(id, size)``: each band's records spread over the band's range by their percentile within it.

    Positions within a band follow from the band's first position: no window runs over a whole band.
    """
    ends = banded.groupBy("band").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("m"))
    rows = banded.join(F.broadcast(ends), "band")
    share = F.when(F.col("m") > 1, 1 - (F.col("position") - F.col("first")) / (F.col("m") - 1)).otherwise(F.lit(1.0))
    lo = reduce(lambda c, i: c.when(F.col("band") == i, F.lit(BAND_SIZES[i][0])), range(1, 3), F.when(F.col("band") == 0, F.lit(BAND_SIZES[0][0])))
    hi = reduce(lambda c, i: c.when(F.col("band") == i, F.lit(BAND_SIZES[i][1])), range(1, 3), F.when(F.col("band") == 0, F.lit(BAND_SIZES[0][1])))
    return rows.select("id", "band", (lo + share * (hi - lo)).alias("size"))


def read_scale(scale: DataFrame) -> list[tuple[int, int]]:
    """A star scale (a row per rung) as a list for column expressions."""
    return repaired([(r["threshold"], r["count"]) for r in scale.collect()])


def latest_scale(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("measured_at")).limit(1)


def describe_rank(spark: SparkSession, stars: int, scale: list[tuple[int, int]], total: int) -> str:
    """``top 0.03 % of 100,000``: a client's text for so many stars."""
    place = spark.range(1).select(star_rank(F.lit(stars), scale).alias("r")).first()["r"]
    return f"top {100 * place / total:.2g} % of {total:,}"


def percentile_of(ranks: DataFrame, values: DataFrame) -> DataFrame:
    """``(id, percentile)`` of each value among ``ranks``: the share not above it, by prefix sums over distinct values."""
    counts = ranks.where("rank is not null").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0))
    table = prefix_sums(counts, "g", "rank").select("rank", ((F.col("before") + F.col("n")) / F.col("all")).alias("percentile"))
    return values.join(table, "rank").select("id", "percentile")

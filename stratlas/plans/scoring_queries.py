"""Star scale, composite, bands, sampling and learning features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.functions.bands import ACTIVITY_BANDS, STAR_BANDS, band_of, days_before
from stratlas.operators import graph as G
from stratlas.operators import scoring as S
from stratlas.plans.registry import query

NOW = "2026-01-01 00:00:00"
RUNGS = ", ".join(f"({t})" for t in S.LADDER)
SCALE = f"sc as (select t::bigint as threshold, (select count(*) from repo where stars >= t) as count from (values {RUNGS}) v(t))"


@query("star_scale", "repo", sql=f"with {SCALE} select threshold, count from sc")
def star_scale(repo):
    return S.star_scale(repo)


@query("star_ranks", "repo", sql=f"""with {SCALE}, k as (select * from sc where count > 0),
n as (select threshold as t0, count as c0, lead(threshold) over (order by threshold) as t1, lead(count) over (order by threshold) as c1 from k)
select id, greatest(1, round_even(case when t1 is null then c0 else exp(ln(c0) + (ln(stars + 1) - ln(t0 + 1)) / (ln(t1 + 1) - ln(t0 + 1)) * (ln(c1) - ln(c0))) end, 0))::bigint as star_rank
from repo join n on stars >= t0 and (t1 is null or stars < t1) where stars is not null""")
def star_ranks(repo):
    scale = S.read_scale(S.star_scale(repo))
    return repo.where("stars is not null").select("id", S.star_rank(F.col("stars"), scale).alias("star_rank"))


N = lambda c, d: f"coalesce(case when isnan({c}) then null else {c} end, {d})"
PARTS = f"""select repo_id as id, least(1, pow(greatest({N('stars', 0)}, 0) / 500000, 0.25)) as stars,
case when {N('dependents', 0)} <= 0 then 0 when {N('dependents', 0)} <= 1 then 0.3 when {N('dependents', 0)} <= 10 then 0.3 + log10(dependents) * 0.2
 when dependents <= 100 then 0.5 + (log10(dependents) - 1) * 0.2 when dependents <= 1000 then 0.7 + (log10(dependents) - 2) * 0.15
 when dependents <= 10000 then 0.85 + (log10(dependents) - 3) * 0.1 when dependents <= 100000 then 0.95 + (log10(dependents) - 4) * 0.05 else 1 end as dependents,
least(1, greatest(0, log10(greatest({N('pagerank_ratio', 1)}, 0.01) + 0.1) / 3 + 0.34)) as pagerank,
least(1, greatest(0, {N('criticality', 0)})) as criticality, least(1, pow(greatest(4 * {N('stars_90d', 0)}, 0) / 500000, 0.25)) as velocity from repo_signals"""
COMPOSITE = f"with p as ({PARTS}), c as (select *, (0.25 * stars + 0.35 * dependents + 0.2 * pagerank + 0.1 * criticality + 0.1 * velocity) * 100 as score from p)"


@query("composite_scores", "repo_signals", sql=COMPOSITE + " select id, round(score, 2) as score, round(stars, 6) as stars, round(dependents, 6) as dependents, round(pagerank, 6) as pagerank, round(criticality, 6) as criticality, round(velocity, 6) as velocity from c")
def composite_scores(signals):
    return S.composite(signals.withColumnRenamed("repo_id", "id"), digits=6)


@query("leaderboard", "repo_signals", sql=COMPOSITE + " select id, round(score, 2) as score from c order by round(score, 2) desc, id limit 100")
def leaderboard(signals):
    return S.leaderboard(composite_scores(signals).select("id", "score"), 100)


@query("score_summary", "repo_signals", sql=COMPOSITE + ", r as (select round(score, 2) as score from c) select max(score) as best, min(score) as worst, count(score) as n, (select score from r order by score desc limit 1 offset (select (count(*) - 1) // 2 from r)) as median from r")
def score_summary(signals):
    return S.summary(composite_scores(signals))


@query("rank_ratios", "world", sql="""
with m as (select avg(rank) filter (rank > 0) as m from world) select repo_id as id, round(case when rank > 0 then rank / m else 1 end, 9) as pagerank_ratio from world, m
""")
def rank_ratios(world):
    return S.rank_ratios(world.select(F.col("repo_id").alias("id"), "rank")).withColumn("pagerank_ratio", F.round("pagerank_ratio", 9))


ORDER = """o as (select id, round(w.rank, 9) as rank, ln(1 + greatest(coalesce(r.stars, 0), 0)) as tiebreak from repo r join world w on w.repo_id = r.id where w.rank is not null),
p as (select *, row_number() over (order by rank desc, tiebreak desc, id) as position, count(*) over () as n from o)"""


def _ordered(repo: DataFrame, world: DataFrame) -> DataFrame:
    ranks = world.where("rank is not null").select(F.col("repo_id").alias("id"), F.round("rank", 9).alias("rank")).join(repo.select("id"), "id", "left_semi")
    return G.importance_order(ranks, repo)


@query("display_sizes", "repo", "world", sql=f"with {ORDER} select id, round(avg((n - position) / (n - 1)) over (partition by rank, tiebreak), 9) as size from p")
def display_sizes(repo, world):
    return S.display_sizes(_ordered(repo, world)).withColumn("size", F.round("size", 9))


BANDED = ORDER + ", b as (select id, position, case when position <= round_even(n * 0.02, 0) then 0 when position <= round_even(n * 0.02, 0) + round_even(n * 0.18, 0) then 1 else 2 end as band from p)"


@query("detail_bands", "repo", "world", sql=f"with {BANDED} select id, position, band from b")
def detail_bands(repo, world):
    return S.bands(_ordered(repo, world))


@query("banded_sizes", "repo", "world", sql=f"""with {BANDED}, r as (select *, row_number() over (partition by band order by position) i, count(*) over (partition by band) m from b)
select id, band, round((case band when 0 then 0.60 when 1 then 0.36 else 0.17 end) + (case when m > 1 then 1 - (i - 1) / (m - 1) else 1 end) * (case band when 0 then 0.40 when 1 then 0.24 else 0.19 end), 9) as size from r""")
def banded_sizes(repo, world):
    return S.banded_sizes(S.bands(_ordered(repo, world))).withColumn("size", F.round("size", 9))


@query("rank_percentiles", "world", sql="""
with w as (select repo_id as id, rank from world where rank is not null)
select id, round(cume_dist() over (order by rank), 9) as percentile from w
""")
def rank_percentiles(world):
    rows = world.where("rank is not null").select(F.col("repo_id").alias("id"), "rank")
    return S.percentile_of(rows, rows).withColumn("percentile", F.round("percentile", 9))


@query("star_activity_bands", "repo", sql="""
select id, (stars >= 10)::int + (stars >= 50)::int + (stars >= 200)::int + (stars >= 1000)::int + (stars >= 5000)::int + (stars >= 25000)::int as star_band,
case when pushed_at is null then null else (d >= 30)::int + (d >= 180)::int + (d >= 730)::int end as activity_band
from (select id, stars, pushed_at, date_diff('microsecond', pushed_at, timestamp '2026-01-01') / 86400000000.0 as d from repo)
""")
def star_activity_bands(repo):
    return repo.select("id", band_of(F.col("stars"), STAR_BANDS).alias("star_band"), band_of(days_before("pushed_at", NOW), ACTIVITY_BANDS).alias("activity_band"))


@query("velocity_by_month", "star_event", sql="select date_trunc('month', starred_at)::date as month, count(*) as stars from star_event where starred_at is not null group by 1")
def velocity_by_month(events):
    return events.where("starred_at is not null").groupBy(F.trunc("starred_at", "month").alias("month")).agg(F.count(F.lit(1)).alias("stars"))

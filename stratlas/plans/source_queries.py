"""Sources, sinks and streams, run over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.operators import graph as G
from stratlas.operators import scoring as S
from stratlas.plans.registry import QUERIES, SQL, query
from stratlas.session import read, work_path
from stratlas.sources import readers, tiles
from stratlas.streaming import stars


def _bands(world: DataFrame) -> DataFrame:
    ranks = world.where("rank is not null and theta is not null and phi is not null").select(F.col("repo_id").alias("id"), F.round("rank", 9).alias("rank"))
    ordered = G.importance_order(ranks, world.select(F.col("repo_id").alias("id"), "stars"))
    banded = S.bands(ordered)
    return S.banded_sizes(banded).join(banded.select("id", "position"), "id")


TILED = f"""w as (select *, round(rank, 9) as rk from world where rank is not null and theta is not null and phi is not null),
p as (select *, row_number() over (order by rk desc, ln(1 + greatest(coalesce(stars, 0), 0)) desc, repo_id) as position, count(*) over () as n from w),
b as (select *, case when position <= round_even(n * 0.02, 0) then 0 when position <= round_even(n * 0.02, 0) + round_even(n * 0.18, 0) then 1 else 2 end as band from p),
r as (select *, row_number() over (partition by band order by position) i, count(*) over (partition by band) m from b),
t as (select band, position, round_even(theta * 32767 / pi(), 0)::int as theta, least(65535, round_even((phi - 2 * pi() * floor(phi / (2 * pi()))) * 65535 / (2 * pi()), 0)::int) as phi,
round_even(65535 * ((case band when 0 then 0.60 when 1 then 0.36 else 0.17 end) + (case when m > 1 then 1 - (i - 1) / (m - 1) else 1 end) * (case band when 0 then 0.40 when 1 then 0.24 else 0.19 end)), 0)::int as size,
coalesce(domain, 0) as domain, (coalesce(low_signal, false)::int | (coalesce(is_archived, false)::int << 1) | (coalesce(is_fork, false)::int << 2)) as flags, position as id from r)"""


@query("tile_points", "world", sql=f"with {TILED} select * from t")
def tile_points(world):
    return tiles.tile_rows(world, _bands(world))


@query("flag_bits", "world", sql="select repo_id, (coalesce(low_signal, false)::int | (coalesce(is_archived, false)::int << 1) | (coalesce(is_fork, false)::int << 2)) as flags from world")
def flag_bits(world):
    return world.select("repo_id", tiles.flags(F.col("low_signal"), F.col("is_archived"), F.col("is_fork")).alias("flags"))


@query("tile_files", "world", sql=f"with {TILED} select band, ((position - 1) // 1048576)::int as part, count(*) as points, (16 + 12 * count(*))::int as bytes from t group by 1, 2")
def tile_files(world):
    rows = tiles.tile_rows(world, _bands(world))
    return tiles.write_tiles(rows, work_path(world.sparkSession, "tiles")).select("band", "part", "points", F.length("tile").alias("bytes"))


@query("tile_sidecars", "world", "repo_signals", sql=f"""with {TILED}, n as (select band, t.position, p.full_name, case when isnan(s.criticality) then null else s.criticality end as score from t join p using (position) left join (select distinct on (repo_id) * from repo_signals) s on s.repo_id = p.repo_id)
select band, ((position - 1) // 1048576)::int as part, list(full_name order by position) as names, list(round(score, 9) order by position) as scores from n group by 1, 2""")
def tile_sidecars(world, signals):
    """The sidecars' JSON read back."""
    rows = world.select(F.col("repo_id").alias("id"), "full_name").join(_bands(world), "id")
    rows = rows.join(signals.select(F.col("repo_id").alias("id"), F.nanvl("criticality", F.lit(None)).alias("score")), "id", "left")
    read_back = F.from_json("json", "names array<string>, scores array<double>")
    return tiles.sidecars(rows).select("band", "part", read_back.alias("j")).select("band", "part", "j.names", F.transform("j.scores", lambda x: F.round(x, 9)).alias("scores"))


@query("api_nodes", "repo", sql="""
select full_name, description, language, stars, forks, open_issues, license, is_fork, is_archived, len(coalesce(topics, []))::int as n_topics, pushed_at from repo where full_name is not null
""")
def api_nodes(repo):
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    topics = F.transform("topics", lambda t: F.struct(F.struct(t.alias("name")).alias("topic")))
    node = F.to_json(F.struct(
        F.col("full_name").alias("nameWithOwner"), "description", F.col("stars").alias("stargazerCount"), F.col("forks").alias("forkCount"), F.col("is_fork").alias("isFork"), F.col("is_archived").alias("isArchived"),
        iso("pushed_at").alias("pushedAt"), iso("created_at").alias("createdAt"), F.struct(F.col("language").alias("name")).alias("primaryLanguage"), F.struct(F.col("license").alias("spdxId")).alias("licenseInfo"),
        F.struct(F.col("open_issues").alias("totalCount")).alias("issues"), F.struct(topics.alias("nodes")).alias("repositoryTopics"),
    ))
    rows = readers.nodes_to_rows(repo.select(F.from_json(node, readers.NODE).alias("n")).select("n.*"))
    return rows.select("full_name", "description", "language", "stars", "forks", "open_issues", "license", "is_fork", "is_archived", F.size("topics").alias("n_topics"), F.col("pushed_at").cast("timestamp_ntz").alias("pushed_at"))


def _criticality(spark: SparkSession, sf: str) -> DataFrame:
    """A dump is written from the signals and read back by the strict reader."""
    rows = read(spark, sf, "repo").select("id", "full_name").join(read(spark, sf, "repo_signals").select(F.col("repo_id").alias("id"), "criticality"), "id")
    path = work_path(spark, "criticality")
    rows.select(F.concat(F.lit("https://github.com/"), "full_name").alias("repo.url"), F.col("criticality").cast("string").alias("default_score")).where("default_score <> 'NaN'").write.option("header", True).csv(path)
    return readers.criticality_strict(spark, path)


QUERIES["criticality_dump"] = _criticality
SQL["criticality_dump"] = "select lower(full_name) as full_name, max(s.criticality) as score from repo join repo_signals s on s.repo_id = repo.id where s.criticality is not null and not isnan(s.criticality) group by 1"


def _months(spark: SparkSession, sf: str) -> DataFrame:
    """Star events written by month; only the asked months are read back."""
    path = work_path(spark, "months")
    rows = read(spark, sf, "star_event").where("starred_at is not null").withColumn("month", F.date_format("starred_at", "yyyyMM").cast("int")).withColumn("type", F.lit("WatchEvent"))
    rows.repartition("month", F.pmod(F.xxhash64("actor"), F.lit(4))).write.partitionBy("month").parquet(path)
    return readers.event_months(spark, path, 202510, 202512).groupBy("month", "repo_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES["event_months"] = _months
SQL["event_months"] = "select strftime(starred_at, '%Y%m')::int as month, repo_id, count(*) as n from star_event where starred_at >= date '2025-10-01' and starred_at < date '2026-01-01' group by 1, 2"


def _stream(spark: SparkSession, sf: str, name: str) -> str:
    """A folder of files, as a stream source needs one."""
    path = work_path(spark, f"stream-{name}")
    read(spark, sf, name).repartition(2).write.parquet(path)
    return path


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, through a Parquet or an in-memory sink, and return what came out."""
    spark = stream.sparkSession
    out, state = work_path(spark, "stream-out"), work_path(spark, "stream-state")
    batches = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(batches).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _velocity_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = stars.velocity(stars.event_stream(spark, _stream(spark, sf, "events"), 2), "event_type", "7 days", None, "400 days")
    last = _finished(rows, "update")
    return last.groupBy("start", "event_type").agg(F.max("n").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES["stream_velocity"] = _velocity_stream
SQL["stream_velocity"] = "select to_timestamp(floor(epoch(ts) / 604800) * 604800)::timestamp as start, event_type, count(*) as n from events group by 1, 2"


def _totals_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = _finished(stars.running_totals(stars.event_stream(spark, _stream(spark, sf, "events"), 2), "user_id"), "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"))


QUERIES["stream_totals"] = _totals_stream
SQL["stream_totals"] = "select user_id, count(*) as n from events group by 1"


def _unique_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = stars.deduplicated(stars.star_stream(spark, _stream(spark, sf, "star_event"), 2), ["actor", "repo_id"], "4000 days")
    return _finished(rows.where("actor is not null").select("actor", "repo_id"), "append").select("actor", "repo_id")


QUERIES["stream_unique_stars"] = _unique_stream
SQL["stream_unique_stars"] = "select distinct actor, repo_id from star_event where actor is not null and ingested_at is not null"


def _upsert_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "stream-table")
    sink = stars.upserting(path, ["actor", "repo_id"], ignore=True)
    rows = stars.star_stream(spark, _stream(spark, sf, "star_event"), 1).where("actor is not null").select("actor", "repo_id")
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", work_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return stars.upserted(spark, path, ["actor", "repo_id"], ignore=True)


QUERIES["stream_upsert"] = _upsert_stream
SQL["stream_upsert"] = "select distinct actor, repo_id from star_event where actor is not null"

"""Records that are kept and looked up: valid scores, alternatives, identities, upserts, pages cleaned again, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.functions.judgement import DIMENSIONS
from stratlas.operators import mutation as M
from stratlas.operators import relational as R
from stratlas.operators import sphere as H
from stratlas.operators import vectors as V
from stratlas.operators.graph import communities
from stratlas.plans.registry import QUERIES, SQL, query
from stratlas.plans.source_queries import TILED, _bands, _finished, _stream
from stratlas.sources import stores, teacher, tiles
from stratlas.streaming import stars


@query("embedded_rows", "embeddings", sql="select vec_id, label from embeddings where embedding is not null order by vec_id")
def embedded_rows(e):
    return e.where("embedding is not null").select("vec_id", "label")


@query("valid_scores", "repo_fetch", "repo", sql="""
select distinct f.repo_id, f.fetch_id from repo_fetch f join repo r on r.id = f.repo_id where f.content_hash is null or f.content_hash = r.content_hash
""")
def valid_scores(fetch, repo):
    """The fetches' hashes stand for those that scores were made of."""
    scores = fetch.select("repo_id", "fetch_id", F.col("content_hash").alias("scored_hash"))
    return R.valid_scores(scores, repo).select("repo_id", "fetch_id").distinct()


@query("alternatives", "edge", "rank_pair", sql="""
with c as (select distinct repo_a as id from rank_pair), e as (select src, dst, kind, weight from edge where src <> dst and weight is not null),
n as (select src as centre, dst as other, kind, weight from e union all select dst, src, kind, weight from e),
g as (select centre, other, kind, max(weight) as weight from n where centre in (select id from c) group by 1, 2, 3), r as (select *, row_number() over (partition by centre order by weight desc, other, kind) as r from g)
select centre, other, round(weight, 9) as weight from r where r <= 200 and kind = 1
""")
def alternatives(edge, pairs):
    return R.alternatives(edge, pairs.select(F.col("repo_a").alias("id"))).withColumn("weight", F.round("weight", 9))


@query("repo_identity", "world", sql=f"""with {TILED}, n as (select position, full_name from p)
select position as ordinal, case when full_name is null or trim(full_name) = '' then 'unnamed' when strpos(full_name, '/') > 1 then left(full_name, strpos(full_name, '/') - 1) else '' end as org,
case when full_name is null or trim(full_name) = '' then 'project-' || left(md5(position::varchar), 6) when strpos(full_name, '/') > 1 then substr(full_name, strpos(full_name, '/') + 1) else full_name end as name from n""")
def repo_identity(world):
    rows = _bands(world).join(world.select(F.col("repo_id").alias("id"), "full_name"), "id")
    return R.identities(rows).select("ordinal", "org", "name")


@query("named_stars", "star_event", "repo", "world", sql="""
select repo_id, count(*) as n from star_event join repo on id = repo_id where lower(full_name) in (select lower(trim(full_name)) from world where full_name is not null) group by 1
""")
def named_stars(events, repo, world):
    names = stores.names_table(world, "wanted_names")
    wanted = repo.select(F.col("id").alias("repo_id"), F.lower("full_name").alias("full_name")).join(names, "full_name", "left_semi")
    return events.join(wanted, "repo_id", "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_edges", "edge", sql="""
with t as (select src, dst, max(weight) as weight, max(observations) as observations from edge where kind = 0 group by 1, 2), u as (select src, dst, max(weight) as weight, max(observations) as observations from edge where kind = 2 group by 1, 2)
select coalesce(t.src, u.src) as src, coalesce(t.dst, u.dst) as dst, coalesce(u.weight, t.weight) as weight, case when u.src is not null then u.observations else t.observations end as observations from t full join u on t.src = u.src and t.dst = u.dst
""")
def upsert_edges(edge):
    """Edges of one kind laid over those of another: a weight that isn't known keeps the one before it."""
    best = lambda kind: edge.where(F.col("kind") == kind).groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.max("observations").alias("observations"))
    return M.merge_upsert(best(0), best(2), ["src", "dst"], coalesce=("weight",))


@query("upsert_ranks", "repo_signals", "world", sql="""
with t as (select repo_id, max(pagerank_ratio) as rank from repo_signals where repo_id is not null group by 1), u as (select repo_id, max(rank) as rank from world group by 1)
select coalesce(t.repo_id, u.repo_id) as repo_id, round(case when u.repo_id is not null then u.rank else t.rank end, 9) as rank from t full join u on t.repo_id = u.repo_id
""")
def upsert_ranks(signals, world):
    before = signals.where("repo_id is not null").groupBy("repo_id").agg(F.max("pagerank_ratio").alias("rank"))
    return M.merge_upsert(before, world.groupBy("repo_id").agg(F.max("rank").alias("rank")), ["repo_id"]).withColumn("rank", F.round("rank", 9))


@query("recleaned_pages", "repo", "repo_fetch", sql="""
with l as (select full_name, arg_max(readme_raw, (fetched_at, fetch_id)) as page from repo_fetch where length(trim(readme_raw)) > 0 and full_name is not null group by 1),
o as (select lower(full_name) as k, max({'n': length(page), 'p': page}) as b from l group by 1)
select r.id, coalesce(o.b.p, r.readme_raw) as readme_raw, o.k is not null as renewed from repo r left join o on o.k = lower(r.full_name)
""")
def recleaned_pages(repo, fetch):
    """The latest page of each fetched project; what is renewed has the hash of its new input."""
    pages = fetch.where(F.length(F.trim("readme_raw")) > 0).where("full_name is not null").groupBy("full_name").agg(F.max_by("readme_raw", F.struct("fetched_at", "fetch_id")).alias("readme_raw"))
    rows = M.recleaned(repo, pages)
    fresh = pages.select(F.lower("full_name").alias("k")).distinct().withColumn("hit", F.lit(True))
    rows = rows.join(fresh, F.lower("full_name") == F.col("k"), "left")
    sound = F.col("content_hash") == F.sha2("embedding_input", 256)
    return rows.select("id", "readme_raw", (F.coalesce("hit", F.lit(False)) & F.coalesce(sound, F.lit(False))).alias("renewed"))


def _judged(signals: DataFrame) -> DataFrame:
    """Signals under the dimensions' names, as judgements that some lack."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    names = ("stars", "dependents", "pagerank_ratio", "criticality", "stars_90d", "stars")
    return signals.where("repo_id is not null").groupBy(F.col("repo_id").alias("id")).agg(*[F.max(value(c)).alias(d) for c, d in zip(names, DIMENSIONS)])


JUDGED = "j as (select repo_id as id, " + ", ".join(f"max(case when isnan({c}) then null else {c} end) as {d}" for c, d in zip(("stars", "dependents", "pagerank_ratio", "criticality", "stars_90d", "stars"), DIMENSIONS)) + " from repo_signals where repo_id is not null group by 1)"


@query("label_rows", "repo", "repo_signals", sql=f"""with {JUDGED}, k as (select * from j where {" and ".join(f"{d} is not null" for d in DIMENSIONS)})
select r.id, k.id is not null as rated, {", ".join(f"round({d}, 6) as {d}" for d in DIMENSIONS)} from (select distinct id from repo) r left join k on k.id = r.id""")
def label_rows(repo, signals):
    rows = teacher.label_matrix(repo, _judged(signals))
    return rows.select("id", "rated", *[F.round(d, 6).alias(d) for d in DIMENSIONS])


@query("kept_composite", "repo_signals", sql=f"""with {JUDGED}
select id, round(list_avg(list_filter([{DIMENSIONS[1]}, {DIMENSIONS[2]}], lambda x: x is not null)), 9) as composite from j""")
def kept_composite(signals):
    return teacher.composite(_judged(signals), [DIMENSIONS[1], DIMENSIONS[2]]).withColumn("composite", F.round("composite", 9))


@query("reduced_norms", "embeddings", sql="""
with f as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), m as (select i, avg(x) as m from f group by 1)
select vec_id, round(sum((x - m) * (x - m)), 5) as squares from f join m using (i) group by 1
""")
def reduced_norms(e):
    """A basis of all directions, written and read back, keeps every centred vector's length."""
    basis = V.Basis.from_json(V.Basis.fit(e, "embedding", 64, 64).to_json())
    rows = basis.reduce(e.select("vec_id", V.doubles("embedding").alias("v")), "v")
    return rows.select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 5).alias("squares"))


@query("reduced_vectors", "embeddings")
def reduced_vectors(e):
    rows = V.Basis.fit(e, "embedding", 64, 48).reduce(e.select("vec_id", V.doubles("embedding").alias("v")), "v")
    return rows.select("vec_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("community_domains", "repo", "world", "edge")
def community_domains(repo, world, edge):
    return H.community_domains(world, communities(repo, edge.where("kind in (0, 1)")))


CHECKS = (
    ("ids are unique", "count(distinct id) = count(*)"), ("positions have no gap", "min(position) = 1 and max(position) = count(*) and count(distinct position) = count(*)"), ("theta in range", "min(theta) >= 0 and max(theta) <= 32767"),
    ("phi in range", "min(phi) >= 0 and max(phi) <= 65535"), ("size in range", "min(size) >= 0 and max(size) <= 65535"), ("domain fits", "min(domain) >= 0 and max(domain) <= 255"), ("flags fit", "min(flags) >= 0 and max(flags) <= 7"),
    ("bands follow one another", "max(position) filter (band = 0) < min(position) filter (band = 1) and max(position) filter (band = 1) < min(position) filter (band = 2)"),
    ("sizes fall by band", "min(size) filter (band = 0) >= max(size) filter (band = 1) and min(size) filter (band = 1) >= max(size) filter (band = 2)"),
    ("first band is a fiftieth", "count(*) filter (band = 0) = round_even(count(*) * 0.02, 0)"), ("second band is 18 of 100", "count(*) filter (band = 1) = round_even(count(*) * 0.18, 0)"), ("bands are all", "count(*) filter (band in (0, 1, 2)) = count(*)"),
)


@query("tile_checks", "world", sql=f"with {TILED} " + " union all ".join(f"""select '{name.replace("'", "''")}' as "check", coalesce({test}, false) as ok from t""" for name, test in CHECKS))
def tile_checks(world):
    return tiles.tile_checks(tiles.tile_rows(world, _bands(world)))


def _sliding(spark: SparkSession, sf: str) -> DataFrame:
    rows = stars.velocity(stars.event_stream(spark, _stream(spark, sf, "events"), 2), "event_type", "6 days", "2 days", "400 days")
    last = _finished(rows, "update")
    return last.groupBy("start", "event_type").agg(F.max("n").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES["stream_sliding"] = _sliding
SQL["stream_sliding"] = """
with e as (select event_type, floor(epoch(ts) / 172800) * 172800 as s from events), w as (select event_type, s - unnest([0, 172800, 345600]) as s from e)
select to_timestamp(s)::timestamp as start, event_type, count(*) as n from w group by 1, 2
"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = stars.sessions(stars.event_stream(spark, _stream(spark, sf, "events"), 2), "user_id", "3 days", "4000 days")
    every = _finished(rows, "complete")  # each batch gives all sessions so far
    last = every.agg(F.max("part").alias("last"))
    return every.join(F.broadcast(last), F.col("part") == F.col("last")).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


QUERIES["stream_sessions"] = _sessions
SQL["stream_sessions"] = """
with l as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 3 days then 0 else 1 end as new from events where user_id is not null),
g as (select *, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as g from l) select min(ts) as start, user_id, count(*) as n from g group by user_id, g
"""

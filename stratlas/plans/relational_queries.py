"""Scans, predicates, joins, aggregations and mutations over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.operators import aggregates as A
from stratlas.operators import mutation as M
from stratlas.operators import relational as R
from stratlas.plans.registry import query

NOW = "2026-01-01 00:00:00"


def _done(fetch: DataFrame) -> DataFrame:
    """The content each repository was last fetched with, as what its embedding was made from."""
    return R.first_by(fetch, "repo_id", [F.col("fetch_id")], "content_hash").select(F.col("repo_id").alias("id"), F.col("content_hash").alias("embedded_hash"))


@query("needs_embedding", "repo", "repo_fetch", sql="""
select id, stars from repo r left join (select repo_id, arg_min_null(content_hash, fetch_id) as embedded_hash from repo_fetch group by 1) d on d.repo_id = r.id
where not coalesce(low_signal, false) and length(embedding_input) > 0 and embedded_hash is distinct from content_hash
""".replace("arg_min_null(content_hash, fetch_id)", "first(content_hash order by fetch_id)"))
def needs_embedding(repo, fetch):
    return R.needs_embedding(repo, _done(fetch)).select("id", "stars")


@query("teacher_candidates", "repo", "world", sql="""
select id, r.full_name, coalesce(r.stars, 0) as stars, coalesce(domain, 0) as domain,
       round(coalesce(date_diff('microsecond', pushed_at, timestamp '2026-01-01') / 86400000000.0, 3650), 6) as days_since_push
from repo r left join world w on w.repo_id = r.id where not coalesce(r.low_signal, false) and length(clean_text) > 0
""")
def teacher_candidates(repo, world):
    return R.teacher_candidates(repo, world, NOW)


@query("text_lengths", "repo", sql="""
select id, coalesce(length(readme_raw), 0)::int as readme_length, coalesce(length(clean_text), 0)::int as clean_length, coalesce(len(topics), 0)::int as n_topics from repo
""")
def text_lengths(repo):
    return R.text_lengths(repo)


@query("world_rows", "world", "repo_signals", sql="""
select w.repo_id, w.theta, w.phi, coalesce(w.cluster_id, -1) as cluster_id, coalesce(w.domain, 0) as domain,
       case when isnan(s.pagerank_ratio) then null else s.pagerank_ratio end as pagerank_ratio
from world w left join repo_signals s using (repo_id) where theta is not null and phi is not null
""")
def world_rows(world, signals):
    rows = world.where("theta is not null and phi is not null").join(signals.select("repo_id", "pagerank_ratio"), "repo_id", "left")
    return rows.select("repo_id", "theta", "phi", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("domain", F.lit(0)).alias("domain"), F.nanvl("pagerank_ratio", F.lit(None).cast("double")).alias("pagerank_ratio"))


@query("rankable_edges", "edge", sql="select src, dst, kind, coalesce(ppmi, weight) as weight from edge where kind in (0, 2)")
def rankable_edges(edge):
    return R.rankable_edges(edge)


@query("find_by_names", "repo", "documents", sql="""
select id, full_name from repo where lower(full_name) in (select lower(full_name) from documents where full_name is not null)
""")
def find_by_names(repo, documents):
    return R.by_names(repo, documents.where("full_name is not null")).select("id", "full_name")


@query("suspect_readmes", "documents", sql="""
with r as (select doc_id as id, text as readme_raw from documents union all select doc_id, path from documents)
select id, readme_raw from r where length(readme_raw) > 0 and length(readme_raw) < 200 and not contains(readme_raw, chr(10))
and not contains(readme_raw, ' ') and (contains(readme_raw, '/') or contains(readme_raw, '.'))
""")
def suspect_readmes(documents):
    """Texts and paths, as if a fetch had landed the address for some."""
    rows = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("readme_raw")).unionByName(documents.select(F.col("doc_id").alias("id"), F.col("path").alias("readme_raw")))
    return R.suspect_readme(rows).select("id", "readme_raw")


@query("approachable", "repo", "repo_signals", sql="""
select r.id, s.criticality as ease from repo r join repo_signals s on s.repo_id = r.id
where not coalesce(is_archived, false) and license is not null and pushed_at > timestamp '2024-01-01' and s.criticality >= 0.02 and not isnan(s.criticality)
""")
def approachable(repo, signals):
    ease = signals.where(~F.isnan("criticality")).select(F.col("repo_id").alias("id"), F.col("criticality").alias("ease"))
    return R.approachable(repo, ease, NOW, 0.02).select("id", "ease")


@query("repo_detail", "repo", sql="""
select id, full_name, case when low_signal then null else nullif(trim(description), '') end as summary, split_part(full_name, '/', 1) as owner, split_part(full_name, '/', 2) as name from repo
""")
def repo_detail(repo):
    return R.detail(repo)


@query("latest_fetch", "repo_fetch", sql="""
select repo_id, arg_max(fetch_id, (fetched_at, fetch_id)) as fetch_id, max(fetched_at) as fetched_at from repo_fetch group by 1
""")
def latest_fetch(fetch):
    return fetch.groupBy("repo_id").agg(F.max_by("fetch_id", F.struct("fetched_at", "fetch_id")).alias("fetch_id"), F.max("fetched_at").alias("fetched_at"))


@query("latest_run", "ingest_run", sql="select run_id, status from ingest_run order by started_at desc limit 1")
def latest_run(runs):
    return runs.orderBy(F.desc("started_at")).limit(1).select("run_id", "status")


@query("run_progress", "ingest_run", sql="""
select coalesce(status, 'died') as status, count(*) as n, count(finished_at) as finished from ingest_run group by 1
""")
def run_progress(runs):
    return runs.groupBy(F.coalesce("status", F.lit("died")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count("finished_at").alias("finished"))


@query("domain_filter", "world", sql="select repo_id, coalesce(domain, 0) <> 2 as dimmed from world")
def domain_filter(world):
    return world.select("repo_id", (F.coalesce("domain", F.lit(0)) != 2).alias("dimmed"))


@query("coverage_fill", "repo", "world", sql="select id, stars from repo where stars >= 10 and id not in (select repo_id from world)")
def coverage_fill(repo, world):
    return repo.where("stars >= 10").join(world.select(F.col("repo_id").alias("id")), "id", "left_anti").select("id", "stars")


@query("enriched_world", "repo", "repo_signals", "world", sql="""
select r.id, r.full_name, r.stars, s.dependents, w.theta, w.phi, w.domain, s.pagerank_ratio
from repo r left join repo_signals s on s.repo_id = r.id left join world w on w.repo_id = r.id
""")
def enriched_world(repo, signals, world):
    return R.enrich(repo, signals, world, signals)


@query("first_document", "repo", "documents", sql="""
select r.id, d.doc_id, d.source from repo r left join lateral (
  select doc_id, source from documents where documents.repo_id = r.id order by doc_id limit 1) d on true
""")
def first_document(repo, documents):
    first = R.first_by(documents.where("repo_id is not null"), "repo_id", [F.col("doc_id")], "doc_id", "source")
    return repo.select("id").join(first.withColumnRenamed("repo_id", "id"), "id", "left")


NAMED = "with named as (select s.full_name as src_name, d.full_name as dst_name, kind from edge e join repo s on s.id = e.src join repo d on d.id = e.dst)"


def _named(edge: DataFrame, repo: DataFrame) -> DataFrame:
    a, b = repo.select(F.col("id").alias("src"), F.col("full_name").alias("src_name")), repo.select(F.col("id").alias("dst"), F.col("full_name").alias("dst_name"))
    return edge.join(a, "src").join(b, "dst").select("src_name", "dst_name", "kind")


@query("resolved_edges", "edge", "repo", sql=NAMED + """, ids as (select lower(full_name) k, min(id) id from repo group by 1)
select kind, a.id as src, b.id as dst from named join ids a on a.k = lower(src_name) join ids b on b.k = lower(dst_name) where a.id <> b.id
""")
def resolved_edges(edge, repo):
    return R.resolve_names(_named(edge, repo), repo)


@query("unmatched_names", "documents", "repo", sql="""
with n as (select full_name as s, split_part(full_name, '/', 2) as d from documents where full_name is not null), k as (select distinct lower(full_name) k from repo)
select (a.k is not null)::int + (b.k is not null)::int as ends_known, count(*) as edges from n left join k a on a.k = lower(s) left join k b on b.k = lower(d) group by 1
""")
def unmatched_names(documents, repo):
    pairs = documents.where("full_name is not null").select(F.col("full_name").alias("src_name"), F.split_part("full_name", F.lit("/"), F.lit(2)).alias("dst_name"))
    return R.unmatched_names(pairs, repo)


@query("package_edges", "edge", "repo", sql=NAMED + """, p as (select distinct lower(host) e, lower(full_name) n, id from repo),
q as (select lower(host) e, lower(src_name) a, lower(dst_name) b from named join (select distinct full_name, host from repo) r on r.full_name = src_name where kind = 0)
select x.id as src, y.id as dst, count(*) as weight from q join p x on x.e = q.e and x.n = q.a join p y on y.e = q.e and y.n = q.b where x.id <> y.id group by 1, 2
""")
def package_edges(edge, repo):
    hosts = repo.select(F.col("full_name").alias("src_name"), "host").distinct()
    needs = _named(edge.where("kind = 0"), repo).join(hosts, "src_name")
    needs = needs.select(F.col("host").alias("ecosystem"), F.col("src_name").alias("name"), F.col("dst_name").alias("requires"))
    return R.package_edges(needs, repo.select(F.col("host").alias("ecosystem"), F.col("full_name").alias("name"), F.col("id").alias("repo_id")))


@query("neighbourhoods", "edge", "repo", "rank_pair", sql="""
with c as (select repo_a as id from rank_pair union select repo_b from rank_pair),
e as (select src, dst, kind, max(coalesce(weight, 0)) as weight from edge where kind in (0, 2) group by all),
h as (select distinct c.id as centre, e.* from e join c on c.id = e.src or c.id = e.dst),
t as (select *, row_number() over (partition by centre order by weight desc, src, dst, kind) r from h)
select centre, src, dst, kind, round(weight, 9) as weight, a.full_name as src_name, b.full_name as dst_name
from t left join repo a on a.id = src left join repo b on b.id = dst where r <= 500
""")
def neighbourhoods(edge, repo, pairs):
    ids = pairs.select(F.explode(F.array("repo_a", "repo_b")).alias("id"))
    return R.neighbourhood(edge, repo, ids, (0, 2)).withColumn("weight", F.round("weight", 9))


@query("not_yet_fetched", "repo", "repo_fetch", sql="select id from repo where id not in (select repo_id from repo_fetch where repo_id is not null)")
def not_yet_fetched(repo, fetch):
    return repo.select("id").join(fetch.select(F.col("repo_id").alias("id")), "id", "left_anti")


@query("quality_report", "repo", sql="""
select count(*) as total, count(*) filter (length(clean_text) > 0) as with_text, count(*) filter (low_signal) as low_signal, count(*) filter (non_english) as non_english,
       count(*) filter (coalesce(length(readme_raw), 0) = 0) as no_readme, count(*) filter (is_fork) as forks, round(avg(clean_reduction), 3) as avg_reduction from repo
""")
def quality_report(repo):
    return A.quality_report(repo)


@query("quality_verdict", "repo", sql="""
with q as (select count(*) as total, count(*) filter (length(clean_text) > 0) as with_text, count(*) filter (low_signal) as low_signal, count(*) filter (non_english) as non_english,
       count(*) filter (coalesce(length(readme_raw), 0) = 0) as no_readme, count(*) filter (is_fork) as forks, round(avg(clean_reduction), 3) as avg_reduction from repo)
select *, with_text / total >= 0.9 and low_signal / total < 0.25 and avg_reduction > 0.35 as passes from q
""")
def quality_verdict(repo):
    return A.quality_verdict(A.quality_report(repo))


@query("stage_report", "repo", "world", "edge", sql="""
select (select count(*) from world where theta is not null) as projected, (select count(distinct cluster_id) filter (cluster_id >= 0) from world) as clusters,
       (select count(*) from edge) as edges, (select count(distinct src) filter (kind = 0) from edge) as dependers, (select count(*) from repo where content_hash is null) as unhashed
""")
def stage_report(repo, world, edge):
    w = world.agg(F.count("theta").alias("projected"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"))
    e = edge.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(F.when(F.col("kind") == 0, F.col("src"))).alias("dependers"))
    r = repo.agg(F.count_if(F.col("content_hash").isNull()).alias("unhashed"))
    one = F.lit(1).alias("one")
    return w.select(one, "*").join(e.select(one, "*"), "one").join(r.select(one, "*"), "one").drop("one")


@query("star_distribution", "repo", sql="""
select min(stars) as min_stars, max(stars) as max_stars, quantile_disc(stars, 0.5)::bigint as median_stars, count(*) filter (stars >= 10) as ge_10,
       count(*) filter (stars >= 100) as ge_100, count(*) filter (stars >= 1000) as ge_1000, count(*) filter (stars >= 10000) as ge_10000 from repo
""")
def star_distribution(repo):
    return A.star_distribution(repo)


@query("top_languages", "repo", sql="select coalesce(nullif(language, ''), '(none)') as language, count(*) as n from repo group by 1 order by n desc, language limit 12")
def top_languages(repo):
    return A.top_values(repo, "language", 12)


@query("reduction_histogram", "repo", sql="""
select case when clean_reduction < 0 then 0 when clean_reduction >= 1 then 11 else floor(clean_reduction / 0.1)::int + 1 end::bigint as bucket, count(*) as n
from repo where clean_reduction is not null and not isnan(clean_reduction) group by 1
""")
def reduction_histogram(repo):
    return A.histogram(repo, "clean_reduction", 0, 1, 10)


@query("edges_by_kind", "edge", sql="select kind, count(*) as edges, count(*) filter (src = dst) as loops, count(*) filter (weight is null) as no_weight from edge group by 1")
def edges_by_kind(edge):
    return A.edges_by_kind(edge)


@query("linked_nodes", "edge", sql="select count(*) as nodes from (select src from edge union select dst from edge)")
def linked_nodes(edge):
    return A.linked_nodes(edge)


@query("star_velocity", "star_event", sql="select repo_id, count(*) as stars_recent from star_event where starred_at >= date '2025-10-01' and starred_at <= date '2025-12-31' group by 1")
def star_velocity(events):
    return A.star_velocity(events, "2025-12-31", 3)


@query("first_stars", "star_event", sql="select actor, repo_id, min(starred_at) as starred_at from star_event where actor is not null and repo_id is not null group by 1, 2")
def first_stars(events):
    return A.first_stars(events)


@query("bounded_actors", "star_event", sql="""
select actor, count(distinct repo_id) as n from star_event where actor is not null and repo_id is not null group by 1 having count(distinct repo_id) between 2 and 400
""")
def bounded_actors(events):
    return A.bounded_actors(events)


@query("signal_mean", "repo_signals", sql="""
select repo_id, round(list_avg(list_filter([nullif(stars, 'nan'), nullif(dependents, 'nan'), nullif(criticality, 'nan'), nullif(stars_90d, 'nan')], lambda x: x is not null)), 9) as mean from repo_signals
""")
def signal_mean(signals):
    cols = ["stars", "dependents", "criticality", "stars_90d"]
    clean = signals.select("repo_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    return clean.select("repo_id", F.round(A.row_mean(cols), 9).alias("mean"))


@query("dependents", "edge", sql="select dst as id, count(*) as dependents from edge where kind = 0 group by 1")
def dependents(edge):
    return A.dependents(edge)


@query("degrees", "edge", sql="""
select id, count(*) filter (kind <> 1 and side = 'in') as in_degree, count(*) filter (kind <> 1 and side = 'out') as out_degree, count(*) filter (kind = 1) as similar_degree
from (select src as id, 'out' as side, kind from edge union all select dst, 'in', kind from edge) group by 1
""")
def degrees(edge):
    return A.degrees(edge)


@query("weight_statistics", "edge", sql="""
select kind, count(*) as n, round(min(weight), 3) as min, round(quantile_cont(weight, 0.5), 3) as median, round(quantile_cont(weight, 0.99), 3) as p99, round(max(weight), 3) as max
from edge where weight is not null group by 1
""")
def weight_statistics(edge):
    return A.weight_statistics(edge)


@query("degree_statistics", "repo", "edge", sql="""
with d as (select r.id, count(e.dst) as d from repo r left join edge e on e.dst = r.id and e.kind = 0 group by 1)
select round(avg(d), 3) as mean, floor(quantile_cont(d, 0.5))::int as median, floor(quantile_cont(d, 0.99))::int as p99, max(d) as max, count(*) filter (d = 0) as zero from d
""")
def degree_statistics(repo, edge):
    return A.degree_statistics(repo, A.dependents(edge), "dependents")


@query("cluster_domains", "world", sql="""
with c as (select cluster_id, domain, count(*) n from world where cluster_id >= 0 and domain is not null group by 1, 2)
select cluster_id, arg_max(domain, (n, -domain)) as domain from c group by 1
""")
def cluster_domains(world):
    return A.modal(world.where("cluster_id >= 0"), "cluster_id", "domain")


GRID = """
with g as (select least(23, floor((1 - cos(theta)) / 2 * 24))::int as ring,
       least(47, floor((phi - 2 * pi() * floor(phi / (2 * pi()))) / (2 * pi()) * 48))::int as slot, count(*) n from world where theta is not null and phi is not null group by 1, 2),
s as (select (i // 48)::int as ring, (i % 48)::int as slot from range(1152) t(i)),
f as (select ring, slot, coalesce(n, 0) as n from s left join g using (ring, slot))
"""


@query("coverage_grid", "world", sql=GRID + "select * from f")
def coverage_grid(world):
    return A.coverage_grid(world)


@query("coverage", "world", sql=GRID + """, r as (select *, row_number() over (order by n, ring, slot) i from f)
select round(count(*) filter (n > 0) / 1152, 6) as occupied, round((2 * sum(i * n) / sum(n) - 1153) / 1152, 6) as gini, round(max(n) / sum(n), 6) as max_share, count(*) filter (n = 0) as empty from r
""")
def coverage(world):
    return A.coverage(world)


@query("topic_counts", "repo", sql="select flag, count(*) as n from (select unnest(topics) as flag from repo) group by 1")
def topic_counts(repo):
    return A.flag_counts(repo, "topics")


@query("landing_delays", "repo_fetch", sql="""
with d as (select date_diff('microsecond', fetched_at, landed_at) / 1e6 as delay from repo_fetch)
select quantile_disc(delay, 0.5) as p50, quantile_disc(delay, 0.99) as p99, count(*) filter (delay > 3600) as dropped, round(count(*) filter (delay > 3600) / count(delay), 6) as drop_ratio from d
""")
def landing_delays(fetch):
    micros = F.unix_micros(F.col("landed_at").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return A.interval_statistics(fetch.select((micros / 1e6).alias("delay")), "delay", 3600.0)


@query("inner_edges", "edge", "world", sql="""
select kind, count(*) as edges, round(sum(coalesce(weight, 0)), 6) as weight from edge e join world a on a.repo_id = src join world b on b.repo_id = dst
where a.domain = b.domain group by 1
""")
def inner_edges(edge, world):
    return A.inner_composition(edge, world.where("domain is not null").select(F.col("repo_id").alias("id"), F.col("domain").alias("label")))


@query("upsert_repo", "repo", "repo_fetch", sql="""
with u as (select repo_id as id, arg_max({'e': embedding_input, 'h': content_hash}, fetch_id) s from repo_fetch group by 1)
select coalesce(r.id, u.id) as id, case when u.id is not null then s.e else r.embedding_input end as embedding_input, coalesce(s.h, r.content_hash) as content_hash, r.stars
from repo r full join u on u.id = r.id
""")
def upsert_repo(repo, fetch):
    updates = fetch.select(F.col("repo_id").alias("id"), "embedding_input", "content_hash", "fetch_id")
    return M.merge_upsert(repo.select("id", "embedding_input", "content_hash", "stars"), updates, ["id"], ["fetch_id"], ("content_hash",))


@query("insert_ignore_stars", "star_event", sql="""
with t as (select actor, repo_id, min(starred_at) as starred_at from star_event where ingested_at < timestamp '2025-07-01' and actor is not null group by 1, 2),
n as (select actor, repo_id, min(starred_at) as starred_at from star_event where ingested_at >= timestamp '2025-07-01' and actor is not null group by 1, 2)
select * from t union all select n.* from n anti join t on t.actor = n.actor and t.repo_id = n.repo_id
""")
def insert_ignore_stars(events):
    rows = events.where("actor is not null").select("actor", "repo_id", "starred_at", "ingested_at")
    at = F.expr("timestamp_ntz '2025-07-01 00:00:00'")
    old = rows.where(F.col("ingested_at") < at).groupBy("actor", "repo_id").agg(F.min("starred_at").alias("starred_at"))
    return M.insert_ignore(old, rows.where(F.col("ingested_at") >= at).drop("ingested_at"), ["actor", "repo_id"])


@query("replace_layer", "edge", sql="""
with n as (select src, dst, max(weight) as weight, max(ppmi) as ppmi, max(observations) as observations from edge where kind = 0 group by 1, 2),
b as (select * from n where src <> dst), u as (select * from b union all select dst, src, weight, ppmi, observations from b)
select src, dst, kind from edge where kind <> 2 union all select distinct src, dst, 2 from u
""")
def replace_layer(edge):
    new = edge.where("kind = 0").groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.max("ppmi").alias("ppmi"), F.max("observations").alias("observations"))
    return M.replace_layer(edge, 2, new, symmetric=True).select("src", "dst", "kind")


@query("update_velocity", "repo", "star_event", sql="""
with v as (select repo_id, count(*)::int n from star_event where starred_at >= date '2025-10-01' group by 1)
select id, coalesce(v.n, stars_90d) as stars_90d from repo left join v on v.repo_id = id
""")
def update_velocity(repo, events):
    recent = events.where("starred_at >= date '2025-10-01'").groupBy(F.col("repo_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("stars_90d"))
    return M.point_update(repo.select("id", "stars_90d"), "id", recent, "stars_90d")


@query("content_hashes", "repo", sql="select id, sha256(clean_text) as content_hash from repo")
def content_hashes(repo):
    return repo.select("id", F.sha2("clean_text", 256).alias("content_hash"))


@query("stale_hashes", "repo", sql="select id from repo where content_hash is distinct from sha256(embedding_input)")
def stale_hashes(repo):
    return repo.where(~F.col("content_hash").eqNullSafe(F.sha2("embedding_input", 256))).select("id")


@query("pricing_summary", "lineitem", sql="""
select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2
""")
def pricing_summary(lineitem):
    rows = lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))

"""Embedding through a client, density clusters, rulers, run reports, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.functions.register import register
from stratlas.operators import density, planning, sphere
from stratlas.operators import graph as G
from stratlas.operators import vectors as V
from stratlas.plans.registry import QUERIES, SQL, query
from stratlas.session import materialise, read
from stratlas.sources import clients, tiles


@query("text_embeddings", "repo", sql="select id, 1.0::double as norm from repo where length(trim(embedding_input)) > 0")
def text_embeddings(repo):
    return clients.embed(repo, "id", "embedding_input", 64).select("id", F.round(V.norm(F.col("v")), 4).alias("norm"))


@query("density_clusters", "world", sql="""
with recursive p as (select repo_id, sin(theta) * cos(phi) x, cos(theta) y, sin(theta) * sin(phi) z from world where theta is not null and phi is not null),
q as (select *, floor(x / 0.02)::bigint gx, floor(y / 0.02)::bigint gy, floor(z / 0.02)::bigint gz from p),
c as (select gx, gy, gz, count(*) n, min(repo_id) id from q group by 1, 2, 3 having count(*) >= 3),
e as (select a.id a, b.id b from c a join c b on abs(a.gx - b.gx) <= 1 and abs(a.gy - b.gy) <= 1 and abs(a.gz - b.gz) <= 1 and a.id <> b.id),
w(id, low) as (select id, id from c union select e.b, w.low from w join e on e.a = w.id where w.low < e.b), l as (select id, min(low) as component from w group by 1),
s as (select component from l join c using (id) group by 1 having sum(n) >= 20), t as (select q.*, component from q left join (c join l using (id) join s using (component)) using (gx, gy, gz)),
m as (select component, ax / r mx, ay / r my, az / r mz from (select *, sqrt(ax*ax + ay*ay + az*az) r from (select component, avg(x) ax, avg(y) ay, avg(z) az from t where component is not null group by 1))),
f as (select repo_id, arg_min(m.component, (round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 12), m.component)) as near from t, m where t.component is null group by 1)
select repo_id, coalesce(component, near, -1) as cluster_id, component is null as is_noise from t left join f using (repo_id)
""")
def density_clusters(world):
    return density.density_clusters(world)


@query("shard_statistics", "repo", sql="""
with s as (select case when stars < 10 then 0 when stars < 100 then 1 when stars < 1000 then 2 else 3 end as b, count(*) as rows from repo where stars is not null group by 1)
select count(*) as shards, min(rows) as min, max(rows) as max, round(avg(rows), 3) as mean, 0::bigint as empty, 0::bigint as stalled from s
""")
def shard_statistics(repo):
    band = F.when(F.col("stars") < 10, 0).when(F.col("stars") < 100, 1).when(F.col("stars") < 1000, 2).otherwise(3)
    shards = repo.where("stars is not null").groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("rows")).withColumn("done", F.lit(True))
    return planning.shard_statistics(shards)


@query("ruler_gaps", "repo", sql="""
with v as (select distinct stars from repo where stars > 0), g as (select ln(stars) - lag(ln(stars)) over (order by stars) as gap from v)
select round(max(gap), 9) as largest_gap, round(avg(gap), 9) as mean_gap, count(gap) as gaps from g
""")
def ruler_gaps(repo):
    values = repo.where("stars > 0").select("stars").distinct()
    band = F.floor(F.log2("stars"))  # distinct values are cut into octaves; the last of one meets the first of the next
    ends = values.groupBy(band.alias("b")).agg(F.min("stars").alias("lo"), F.max("stars").alias("hi"))
    inner = values.withColumn("b", band).select((F.log("stars") - F.log(F.lag("stars").over(W.partitionBy("b").orderBy("stars")))).alias("gap"))
    outer = ends.select((F.log("lo") - F.log(F.lag("hi").over(W.orderBy("b")))).alias("gap"))  # a row per octave
    gaps = inner.unionByName(outer).where("gap is not null")
    return gaps.agg(F.round(F.max("gap"), 9).alias("largest_gap"), F.round(F.avg("gap"), 9).alias("mean_gap"), F.count(F.lit(1)).alias("gaps"))


@query("star_rulers", "repo", sql="""
select id, round(pow(stars / 500000.0, 1.0 / 3), 9) as root3, round(pow(stars / 500000.0, 0.25), 9) as root4, round(ln(1 + stars) / ln(500001), 9) as log_ruler from repo where stars is not null
""")
def star_rulers(repo):
    s = F.col("stars")
    return repo.where("stars is not null").select("id", F.round(F.pow(s / 500000.0, F.lit(1.0 / 3)), 9).alias("root3"), F.round(F.pow(s / 500000.0, F.lit(0.25)), 9).alias("root4"), F.round(F.log1p(s.cast("double")) / F.log(F.lit(500001.0)), 9).alias("log_ruler"))


@query("random_sample", "repo", sql="select id, left(clean_text, 400) as head from repo where not coalesce(low_signal, false) order by md5(id || '-42'), id limit 100")
def random_sample(repo):
    rows = repo.where("not coalesce(low_signal, false)").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("-42"))), "id").limit(100)
    return rows.select("id", F.substring("clean_text", 1, 400).alias("head"))


def _sql_functions(spark, sf):
    register(spark)
    read(spark, sf, "repo").createOrReplaceTempView("catalogue_repo")
    return spark.sql("select p.a, p.b, count(*) as n from catalogue_repo, lateral pairs(topics) p group by 1, 2")


QUERIES["topic_pairs"] = _sql_functions
SQL["topic_pairs"] = """
with t as (select distinct id, unnest(topics) as t from repo), n as (select x.id, x.t as a, y.t as b from t x join t y on x.id = y.id and x.t < y.t) select a, b, count(*) as n from n group by 1, 2
"""


@query("regions", "world")
def regions(world):
    return sphere.regions(world, max(1, min(400, sphere.placed(world).count() // 20)))


@query("baseline_distance", "world", sql="""
with p as (select repo_id, sin(theta) * cos(phi) x, cos(theta) y, sin(theta) * sin(phi) z from world where theta is not null and phi is not null),
o as (select *, row_number() over (order by md5(repo_id || '-5'), repo_id) i, count(*) over () n from p)
select round(avg(atan2(sqrt((a.y*b.z - a.z*b.y)**2 + (a.z*b.x - a.x*b.z)**2 + (a.x*b.y - a.y*b.x)**2), a.x*b.x + a.y*b.y + a.z*b.z)), 6) as mean_distance, count(*) as pairs from o a join o b on b.i = a.i % a.n + 1
""")
def baseline_distance(world):
    return sphere.baseline_distance(world)


@query("recommended_strip", "embeddings")
def recommended_strip(e):
    k, tried = V.recommended_strip(e, "embedding", 64)
    return e.sparkSession.createDataFrame([(k, i, float(c)) for i, c in enumerate(tried)], "chosen int, stripped int, cosine double")


@query("community_sweep", "repo", "edge")
def community_sweep(repo, edge):
    weighed = edge.withColumn("weight", F.coalesce("weight", F.lit(1.0)) * F.when(F.col("kind") == 1, 0.4).otherwise(1.0))
    sources = {"all": weighed, "deps": weighed.where("kind in (0, 2)"), "similar": weighed.where("kind = 1")}
    return G.sweep(repo, sources, (20.0, 10.0, 5.0, 2.0, 1.0, 0.5))


FACTS = (
    "ranks are positive", "ranks sum to 1", "ranks don't rise", "ranks spread", "offsets begin at 0", "offsets don't fall", "offsets end with the targets", "ends are nodes", "each entry has its mirror", "no loops",
    "no entry twice", "kinds are known", "as many in as out", "arcs are few", "no arc twice", "arcs spread over nodes", "arcs join strong nodes",
)


@query("graph_checks", "repo", "world", "edge", sql="""select unnest([{}]) as "check", true as ok""".format(", ".join("'" + x.replace("'", "''") + "'" for x in FACTS)))
def graph_checks(repo, world, edge):
    ranks = world.where("rank is not null").select(F.col("repo_id").alias("id"), "rank")
    whole = ranks.agg(F.sum("rank").alias("s"))
    ranks = ranks.join(F.broadcast(whole), F.lit(True)).select("id", (F.col("rank") / F.col("s")).alias("rank"))
    ordered = G.importance_order(ranks, repo)
    links = G.unit_weights(edge.where("src <> dst and weight is not null").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight")))
    raw = tiles.graph_file(ordered, links, G.backbone(links, ranks))
    facts = tiles.graph_facts(tiles.decode_graph(raw))
    return repo.sparkSession.createDataFrame([(name, bool(ok)) for name, ok in facts.items()], "check string, ok boolean")


STABILITY = """
b as (select src, dst, sum(w) as w from (select src, dst, w from links where src <> dst union all select dst, src, w from links where src <> dst) group by 1, 2), o as (select src, sum(w) as k from b group by 1),
w as (select b.src, dst, w / k as p from b join o using (src)), a as (select o.src as id, label, k / (select sum(k) from o) as pi from o join labels on labels.id = o.src),
t(time, n, id, c, x) as (select time, 0, id, label, 1.0::double from a, times union all
  select time, n + 1, id, c, x from (select time, n, id, c, sum(x) * time / (n + 1) as x from (select t.time, t.n, w.src as id, t.c, p * x as x from w join t on t.id = w.dst union all select time, n, id, c, -x from t) where n < 12 group by 1, 2, 3, 4)),
z as (select time, sum(pi * x) as kept from t join a using (id) where c = label group by 1), u as (select sum(s * s) as chance from (select sum(pi) as s from a group by label))
select times.time, round(coalesce(kept, 0) - coalesce(chance, 0), 6) as stability from times left join z using (time), u
"""


@query("nation_trade_stability", "customer", "orders", "lineitem", "supplier", "nation", sql=f"""with recursive links as (select c_nationkey as src, s_nationkey as dst, count(*)::double as w from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where c_nationkey <> s_nationkey group by 1, 2),
labels as (select n_nationkey as id, n_regionkey as label from nation), times as (select 1.0::double as time), {STABILITY}""")
def nation_trade_stability(customer, orders, lineitem, supplier, nation):
    trade = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    trade = trade.join(customer.select("c_custkey", F.col("c_nationkey").alias("src")), "c_custkey").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    edges = trade.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    labels = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    value = G.stability(materialise(edges, "trade-edges"), labels, 1.0)
    return nation.sparkSession.createDataFrame([(1.0, round(value, 6))], "time double, stability double")


@query("domain_stability", "world", "edge", sql=f"""with recursive links as (select src, dst, coalesce(weight, 1.0)::double as w from edge), labels as (select repo_id as id, domain as label from world where domain is not null),
times as (select unnest([0.5, 1.0, 2.0])::double as time), {STABILITY}""")
def domain_stability(world, edge):
    labels = world.where("domain is not null").select(F.col("repo_id").alias("id"), F.col("domain").alias("label"))
    edges = materialise(edge.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight")), "stability-edges")
    rows = [(t, round(G.stability(edges, labels, t), 6)) for t in (0.5, 1.0, 2.0)]
    return world.sparkSession.createDataFrame(rows, "time double, stability double")


@query("nation_trade", "customer", "orders", "lineitem", "supplier", sql="""
select c_nationkey as src, s_nationkey as dst, count(*) as weight from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
where c_nationkey <> s_nationkey group by 1, 2
""")
def nation_trade(customer, orders, lineitem, supplier):
    trade = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    trade = trade.join(customer.select("c_custkey", F.col("c_nationkey").alias("src")), "c_custkey").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    return trade.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))

"""Vectors and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratlas.operators import sphere as H
from stratlas.operators import vectors as V
from stratlas.plans.registry import query
from stratlas.session import read
from stratlas.plans.registry import QUERIES, SQL

WIDTH = 64
UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)"


@query("unit_vectors", "embeddings", sql="select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)) / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as total from embeddings")
def unit_vectors(e):
    total = F.aggregate(V.normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(total, 6).alias("total"))


@query("packed_vectors", "embeddings", sql="select vec_id, (len(embedding) * 4)::int as bytes, round(embedding[1]::double, 6) as first from embeddings")
def packed_vectors(e):
    rows = e.withColumn("b", V.packed("embedding"))
    return rows.select("vec_id", F.length("b").alias("bytes"), F.round(V.unpacked("b", WIDTH)[0].cast("double"), 6).alias("first"))


@query("pair_cosine", "embeddings", sql=f"""with {UNIT}, p as (select list_dot_product(a.v, b.v) as c from u a join u b on a.vec_id < b.vec_id) select round(avg(c), 6) as cosine from p""")
def pair_cosine(e):
    rows = e.withColumn("v", V.normalised(F.col("embedding")))
    return V.pair_cosine(V.sums_by(rows, "v", WIDTH)).select(F.round("cosine", 6).alias("cosine"))


@query("label_purity", "embeddings", sql=f"""with {UNIT}, p as (select a.label as x, b.label as y, list_dot_product(a.v, b.v) as c from u a join u b on a.vec_id < b.vec_id),
w as (select x as label, avg(c) as cosine from p where x = y group by 1), n as (select label, count(*) n from u group by 1 having count(*) > 1), z as (select avg(c) as base from p)
select round(avg(cosine), 6) as mean_within, round(any_value(base), 6) as baseline, round(avg(cosine) - any_value(base), 6) as lift, quantile_cont(n, 0.5) as median_size,
case when abs(any_value(base)) > 0.02 then round(avg(cosine) / any_value(base), 6) end as ratio, arg_min(label, (cosine, label)) as weakest from w join n using (label), z""")
def label_purity(e):
    return V.purity(e.withColumn("v", V.normalised(F.col("embedding"))), "v", "label", WIDTH)


@query("label_centroids", "embeddings", sql=f"""with {UNIT}, f as (select label, generate_subscripts(v, 1) i, unnest(v) x from u), s as (select label, i, sum(x) t from f group by 1, 2), n as (select label, count(*) n from u group by 1)
select label, n, round(sqrt(sum(t * t)) / n, 6) as tightness from s join n using (label) group by 1, 2""")
def label_centroids(e):
    rows = V.centroids(e.withColumn("v", V.normalised(F.col("embedding"))), "v", "label", WIDTH)
    return rows.select("label", "n", F.round("tightness", 6).alias("tightness"))


@query("whitened_cosine", "embeddings")
def whitened_cosine(e):
    mean, axes = V.fit_whitening(e, "embedding", WIDTH, 2)
    rows = V.whiten(e.select("vec_id", V.doubles("embedding").alias("v")), "v", mean, axes)
    return V.pair_cosine(V.sums_by(rows, "v", WIDTH)).select("n", F.round("cosine", 6).alias("cosine"))


QUERYSET = f"{UNIT}, c as (select q.vec_id as query, b.vec_id as id, round(list_dot_product(q.v, b.v), 9) as cosine from u q join u b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query order by cosine desc, id) r from c)"


@query("nearest_vectors", "embeddings", sql=f"with {QUERYSET} select query, id, round(cosine, 6) as cosine, r::int as r from r where r <= 10")
def nearest_vectors(e):
    rows = V.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
    return rows.select("query", "id", F.round("cosine", 6).alias("cosine"), "r")


@query("index_recall", "embeddings", sql="select true as enough, (select count(*) from embeddings where vec_id % 100 = 0) * 10 as wanted")
def index_recall(e):
    asked = e.where("vec_id % 100 = 0")
    exact = V.nearest(asked, e, "vec_id", "embedding", 10).select("query", "id")
    found = V.ListIndex(e, "vec_id", "embedding").nearest(asked, 10).select("query", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query", "id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"), F.count(F.lit(1)).alias("wanted"))


@query("adopted_labels", "embeddings", sql=f"""with {UNIT}, c as (select q.vec_id as id, b.label, b.vec_id as anchor, round(list_dot_product(q.v, b.v), 9) as cosine from u q join u b on q.vec_id % 100 = 0 and b.vec_id % 100 <> 0)
select id, arg_max(label, (cosine, -anchor)) as label from c group by 1""")
def adopted_labels(e):
    return V.adopt(e.where("vec_id % 100 = 0"), e.where("vec_id % 100 <> 0"), "vec_id", "embedding", "label")


@query("similar_edges", "embeddings")
def similar_edges(e):
    return V.knn_edges(V.ListIndex(e, "vec_id", "embedding").nearest(e, 8), 0.8, 8)


@query("vector_clusters", "embeddings")
def vector_clusters(e):
    return V.spherical_kmeans(e, "vec_id", "embedding", 10, WIDTH)[0]


def _dense(spark, sf):
    e = read(spark, sf, "embeddings")
    asked = e.orderBy("vec_id").limit(1).select(V.doubles("embedding")).first()[0]
    return V.search(e, "vec_id", "embedding", asked, 100).select("vec_id", F.round("score", 6).alias("score"))


QUERIES["dense_search"] = _dense
SQL["dense_search"] = f"with {UNIT}, q as (select v from u order by vec_id limit 1) select vec_id, round(s, 6) as score from (select vec_id, list_dot_product(u.v, q.v) s from u, q order by round(s, 9) desc, vec_id limit 100)"

POS = "p as (select *, sin(theta) * cos(phi) x, cos(theta) y, sin(theta) * sin(phi) z from world where theta is not null and phi is not null)"
MOD = "({0} - 2 * pi() * floor({0} / (2 * pi())))"


@query("positions", "world", sql=f"with {POS} select repo_id, round(x, 9) as x, round(y, 9) as y, round(z, 9) as z from p")
def positions(world):
    return H.placed(world).select("repo_id", *[F.round(c, 9).alias(c) for c in "xyz"])


@query("angles_back", "world", sql=f"with {POS} select repo_id, round(acos(y), 6) as theta, round(sin(atan2(z, x)), 6) as sin_phi, round(cos(atan2(z, x)), 6) as cos_phi from p")
def angles_back(world):
    theta, phi = H.angles(F.col("x"), F.col("y"), F.col("z"))
    return H.placed(world).select("repo_id", F.round(theta, 6).alias("theta"), F.round(F.sin(phi), 6).alias("sin_phi"), F.round(F.cos(phi), 6).alias("cos_phi"))


@query("wrapped_positions", "world", sql=f"""with t as (select repo_id, {MOD.format('(theta * 3)')} as t, phi from world where theta is not null and phi is not null)
select repo_id, round(case when t > pi() then 2 * pi() - t else t end, 6) as theta, round(cos(case when t > pi() then phi + pi() else phi end), 6) as cos_phi from t""")
def wrapped_positions(world):
    theta, phi = H.wrapped(F.col("theta") * 3, F.col("phi"))
    return world.where("theta is not null and phi is not null").select("repo_id", F.round(theta, 6).alias("theta"), F.round(F.cos(phi), 6).alias("cos_phi"))


PAIRS = f"with {POS} select repo_a, repo_b, round(atan2(sqrt((a.y*b.z-a.z*b.y)**2 + (a.z*b.x-a.x*b.z)**2 + (a.x*b.y-a.y*b.x)**2), a.x*b.x+a.y*b.y+a.z*b.z), 9) as distance from rank_pair join p a on a.repo_id = repo_a join p b on b.repo_id = repo_b"


@query("pair_distances", "rank_pair", "world", sql=PAIRS)
def pair_distances(pairs, world):
    p = H.placed(world)
    a = p.select(F.col("repo_id").alias("repo_a"), F.struct("x", "y", "z").alias("a"))
    b = p.select(F.col("repo_id").alias("repo_b"), F.struct("x", "y", "z").alias("b"))
    away = H.great_circle(*[tuple(F.col(f"{n}.{c}") for c in "xyz") for n in "ab"])
    return pairs.join(a, "repo_a").join(b, "repo_b").select("repo_a", "repo_b", F.round(away, 9).alias("distance"))


MEANS = f"{POS}, m as (select domain, count(*) n, avg(x) ax, avg(y) ay, avg(z) az from p where domain is not null group by 1), r as (select *, sqrt(ax*ax + ay*ay + az*az) r from m)"


@query("domain_means", "world", sql=f"with {MEANS} select domain, n, round(ax / r, 6) as mx, round(ay / r, 6) as my, round(az / r, 6) as mz, round(r, 6) as r from r")
def domain_means(world):
    rows = H.spherical_means(H.placed(world.where("domain is not null")), "domain")
    return rows.select("domain", "n", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz", "r")])


@query("cluster_manifest", "world", sql=f"""with {POS}, m as (select cluster_id, count(*) n, avg(x) ax, avg(y) ay, avg(z) az from p where cluster_id >= 0 group by 1), r as (select *, sqrt(ax*ax + ay*ay + az*az) r from m),
d as (select cluster_id, arg_max(domain, (c, -domain)) as domain from (select cluster_id, domain, count(*) c from p where cluster_id >= 0 and domain is not null group by 1, 2) group by 1)
select cluster_id, n as size, round(acos(ay / r), 6) as theta, round(case when r >= 0.9999 then 1e4 else r * (3 - r * r) / (1 - r * r) end, 2) as kappa, coalesce(domain, 0) as domain
from r left join d using (cluster_id) order by n desc, cluster_id limit 400""")
def cluster_manifest(world):
    return H.manifest(world).select("cluster_id", "size", F.round("theta", 6).alias("theta"), F.round("kappa", 2).alias("kappa"), "domain")


@query("quantised_positions", "world", sql=f"""select repo_id, round_even(theta * 32767 / pi(), 0)::int as t, least(65535, round_even({MOD.format('phi')} * 65535 / (2 * pi()), 0)::int) as p, round_even(least(1, greatest(0, rank)) * 65535, 0)::int as s
from world where theta is not null and phi is not null and rank is not null""")
def quantised_positions(world):
    t, p, s = H.quantised(F.col("theta"), F.col("phi"), F.col("rank"))
    return world.where("theta is not null and phi is not null and rank is not null").select("repo_id", t.alias("t"), p.alias("p"), s.alias("s"))


@query("domain_viewport", "world", sql=f"""with {POS}, d as (select * from p where domain = 1), a as (select avg(x) ax, avg(y) ay, avg(z) az from d), m as (select ax / r as mx, ay / r as my, az / r as mz from (select *, sqrt(ax*ax + ay*ay + az*az) r from a)),
s as (select mx, my, mz, greatest(0.04, max(atan2(sqrt((y*mz - z*my)**2 + (z*mx - x*mz)**2 + (x*my - y*mx)**2), x*mx + y*my + z*mz))) as spread from d, m group by 1, 2, 3)
select round(acos(my), 6) as theta, round(sin(atan2(mz, mx)), 6) as sin_phi, round(spread, 6) as spread, round(1.18 + 1.7 * spread, 6) as altitude from s""")
def domain_viewport(world):
    seen = H.viewport(H.placed(world.where("domain = 1")))
    return seen.select(F.round("theta", 6).alias("theta"), F.round(F.sin("phi"), 6).alias("sin_phi"), F.round("spread", 6).alias("spread"), F.round("altitude", 6).alias("altitude"))


@query("projected_vectors", "embeddings")
def projected_vectors(e):
    return H.project(e, "vec_id", "embedding", WIDTH)


@query("expectation_checks", "rank_pair", "repo", "world", sql=f"""with q as ({PAIRS}) select 'ranked pairs' as "check", round(avg(distance), 6) as mean_distance, avg(distance) >= 0.5 as ok from q""")
def expectation_checks(pairs, repo, world):
    names = repo.select("id", "full_name")
    rows = pairs.join(names.select(F.col("id").alias("repo_a"), F.col("full_name").alias("a")), "repo_a").join(names.select(F.col("id").alias("repo_b"), F.col("full_name").alias("b")), "repo_b")
    wanted = rows.select(F.lit("ranked pairs").alias("check"), "a", "b", F.lit(0.5).alias("limit"), F.lit(False).alias("near"))
    return H.expectations(world, wanted).select("check", F.round("mean_distance", 6).alias("mean_distance"), "ok")

"""Edge layers, co-use, ranks, components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.operators import graph as G
from stratlas.operators.ordering import global_positions
from stratlas.plans.registry import query

LAYERS = {0: 1.0, 2: 0.7}

LAYER_SQL = """
w as (select src, dst, kind, coalesce(ppmi, weight, 1) as weight from edge where kind in (0, 2)),
l as (select src, dst, kind, weight / avg(weight) over (partition by kind) * case kind when 0 then 1.0 else 0.7 end as weight from w)
"""


def layers(edge: DataFrame) -> DataFrame:
    return G.normalised_layers(edge.withColumn("weight", F.coalesce("ppmi", "weight")), LAYERS)


@query("combined_layers", "edge", sql=f"with {LAYER_SQL} select src, dst, kind, round(weight, 9) as weight from l")
def combined_layers(edge):
    return layers(edge).withColumn("weight", F.round("weight", 9))


@query("unit_weights", "edge", sql="""
with e as (select src, dst, kind, weight from edge where weight is not null), m as (select min(weight) lo, max(weight) hi from e)
select src, dst, kind, round(case when hi = lo then 0.5 else (weight - lo) / (hi - lo) end, 9) as weight from e, m
""")
def unit_weights(edge):
    return G.unit_weights(edge.where("weight is not null").select("src", "dst", "kind", "weight")).withColumn("weight", F.round("weight", 9))


@query("adjacency", "edge", sql="""
select src, count(*) as entries, round(sum(weight), 6) as weight from (select src, dst, coalesce(weight, 0) as weight from edge where src <> dst union all select dst, src, coalesce(weight, 0) from edge where src <> dst) group by 1
""")
def adjacency(edge):
    return G.symmetric(edge).groupBy("src").agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6).alias("weight"))


BASKETS = """
d as (select distinct actor, repo_id as item from star_event where actor is not null and repo_id is not null),
s as (select actor, count(*) n from d group by 1 having count(*) between 2 and 400), b as (select d.actor, item, 1 / ln(n + 1) as w from d join s using (actor)),
p as (select x.item as a, y.item as b, sum(x.w) as w from b x join b y on x.actor = y.actor and x.item < y.item group by 1, 2),
i as (select item, sum(w) as w from b group by 1), t as (select sum(w) as total from (select actor, any_value(w) as w from b group by 1)),
m as (select p.a, p.b, ln((p.w / total) / ((ia.w / total) * pow(ib.w / total, 0.75))) as ppmi, trunc(p.w)::int as observations
      from p join i ia on ia.item = p.a join i ib on ib.item = p.b, t where p.w >= 3)
"""


def star_baskets(events: DataFrame) -> DataFrame:
    return G.baskets(events, "actor", "repo_id")


@query("basket_sizes", "star_event", sql=f"with {BASKETS} select actor, count(*) as n, round(max(w), 9) as w from b group by 1")
def basket_sizes(events):
    return star_baskets(events).groupBy("actor").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("w"), 9).alias("w"))


@query("pair_weights", "star_event", sql=f"with {BASKETS} select a, b, round(w, 6) as w from p")
def pair_weights(events):
    return G.pair_weights(star_baskets(events)).withColumn("w", F.round("w", 6))


@query("ppmi", "star_event", sql=f"with {BASKETS} select a, b, round(ppmi, 6) as ppmi, observations from m where ppmi > 0")
def ppmi(events):
    return G.ppmi(star_baskets(events)).withColumn("ppmi", F.round("ppmi", 6))


ENDS = "e as (select a as item, b as other, round(ppmi, 9) as ppmi from m where ppmi > 0 union all select b, a, round(ppmi, 9) from m where ppmi > 0), r as (select *, row_number() over (partition by item order by ppmi desc, other) r from e)"


def _scores(events: DataFrame) -> DataFrame:
    return G.ppmi(star_baskets(events)).withColumn("ppmi", F.round("ppmi", 9))


@query("top_pairs", "star_event", sql=f"with {BASKETS}, {ENDS} select item, other, round(ppmi, 6) as ppmi, r::int as r from r where r <= 12")
def top_pairs(events):
    return G.ranked_ends(_scores(events), "ppmi", 12).withColumn("ppmi", F.round("ppmi", 6))


@query("mutual_pairs", "star_event", sql=f"""with {BASKETS}, {ENDS}
select x.item as a, x.other as b, round(x.ppmi, 6) as ppmi from r x join r y on x.item = y.other and x.other = y.item where x.r <= 12 and y.r <= 12 and x.item < x.other""")
def mutual_pairs(events):
    return G.mutual_top_k(_scores(events), "ppmi", 12).withColumn("ppmi", F.round("ppmi", 6))


TOPICS = """
d as (select distinct id as actor, item from (select id, unnest(topics) as item from repo) where item is not null),
s as (select actor, count(*) n from d group by 1 having count(*) between 2 and 400), b as (select d.actor, item, 1 / ln(n + 1) as w from d join s using (actor)),
p as (select x.item as a, y.item as b, sum(x.w) as w from b x join b y on x.actor = y.actor and x.item < y.item group by 1, 2),
i as (select item, sum(w) as w from b group by 1), t as (select sum(w) as total from (select actor, any_value(w) as w from b group by 1)),
m as (select p.a, p.b, ln((p.w / total) / ((ia.w / total) * (ib.w / total))) as ppmi, trunc(p.w)::int as observations
      from p join i ia on ia.item = p.a join i ib on ib.item = p.b, t where p.w >= 1)
"""


@query("topic_co_use", "repo", sql=f"""with {TOPICS}, {ENDS}
select x.item as a, x.other as b, round(x.ppmi, 6) as ppmi from r x join r y on x.item = y.other and x.other = y.item where x.r <= 12 and y.r <= 12 and x.item < x.other""")
def topic_co_use(repo):
    events = repo.select("id", F.explode("topics").alias("topic"))
    scores = G.ppmi(G.baskets(events, "id", "topic"), least=1.0, smoothing=1.0).withColumn("ppmi", F.round("ppmi", 9))
    return G.mutual_top_k(scores, "ppmi", 12).withColumn("ppmi", F.round("ppmi", 6))


@query("mutual_edges", "edge", sql="""
with s as (select distinct src, dst from edge where src <> dst)
select a.src as a, a.dst as b from s a join s b on a.src = b.dst and a.dst = b.src where a.src < a.dst
""")
def mutual_edges(edge):
    rows = edge.where("src <> dst").select("src", "dst").distinct()
    both = rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return both.where("n = 2").select("a", "b")


def _pagerank_sql(rounds: int) -> str:
    ctes = [LAYER_SQL, "n as (select id from repo)", "c as (select count(*)::double as n from repo)",
            "k as (select src, dst, sum(weight) as weight from l where src in (select id from n) and dst in (select id from n) and weight <> 0 group by 1, 2)",
            "o as (select src, sum(weight) as s from k group by 1)", "h as (select k.src, dst, weight / s as share from k join o using (src))",
            "r0 as (select id, 1 / n as rank from n, c)"]
    for i in range(rounds):
        ctes.append(f"d{i} as (select coalesce(sum(rank), 0) as m from r{i} where id not in (select src from o))")
        ctes.append(f"g{i} as (select dst as id, sum(rank * share) as got from r{i} join h on h.src = r{i}.id group by 1)")
        ctes.append(f"r{i + 1} as (select r{i}.id, 0.15 / n + 0.85 * (coalesce(got, 0) + m / n) as rank from r{i} left join g{i} using (id), c, d{i})")
    return "with " + ",\n".join(ctes) + f"\nselect id, round(rank, 12) as rank from r{rounds}"


@query("pagerank_5", "repo", "edge", sql=_pagerank_sql(5))
def pagerank_5(repo, edge):
    return G.pagerank(repo, layers(edge), tolerance=0.0, most=5).withColumn("rank", F.round("rank", 12))


PAGERANK = f"""with recursive {LAYER_SQL}, c as (select count(*)::double as n from repo), k as (select src, dst, sum(weight) as weight from l where src in (select id from repo) and dst in (select id from repo) and weight <> 0 group by 1, 2),
o as (select src, sum(weight) as s from k group by 1), h as (select k.src, dst, weight / s as share from k join o using (src)),
r(i, id, rank) as (select 0, id, 1 / n from repo, c union all
  select x.i + 1, x.id, 0.15 / n + 0.85 * (coalesce(got, 0) + m / n) from r x left join (select h.dst as id, sum(r.rank * h.share) as got from r join h on h.src = r.id group by 1) g using (id), c,
  (select coalesce(sum(rank), 0) as m from r where id not in (select src from o)) d where x.i < 170)
select id, round(rank, 7) as rank from r where i = 170"""


@query("pagerank", "repo", "edge", sql=PAGERANK)
def pagerank(repo, edge):
    return G.pagerank(repo, layers(edge)).withColumn("rank", F.round("rank", 7))


@query("importance_order", "repo", "world", sql="""
select id, row_number() over (order by round(w.rank, 9) desc, ln(1 + greatest(coalesce(r.stars, 0), 0)) desc, id) as position from repo r join world w on w.repo_id = r.id where w.rank is not null and not isnan(w.rank)
""")
def importance_order(repo, world):
    ranks = world.where("rank is not null and not isnan(rank)").select(F.col("repo_id").alias("id"), F.round("rank", 9).alias("rank"))
    return G.importance_order(ranks.join(repo.select("id"), "id", "left_semi"), repo).select("id", "position")


@query("top_ranked", "world", sql="select repo_id, round(rank, 9) as rank from world where rank is not null order by round(rank, 9) desc, repo_id limit 100")
def top_ranked(world):
    return world.where("rank is not null").select("repo_id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "repo_id").limit(100)


COMPONENTS = """
with recursive e as (select distinct src a, dst b from edge where kind = 1 and src <> dst and src in (select id from repo) and dst in (select id from repo) union select dst, src from edge where kind = 1 and src <> dst and src in (select id from repo) and dst in (select id from repo)),
c(id, label) as (select id, id from repo union select e.b, c.label from c join e on e.a = c.id where c.label < e.b),
l as (select id, min(label) as component from c group by 1), s as (select component, count(*) n from l group by 1)
select count(*) as components, max(n) as largest, count(*) filter (n = 1) as isolated from s
"""


LABELS = COMPONENTS.split("s as (")[0].rstrip().rstrip(",")


@query("components", "repo", "edge", sql=LABELS + " select id, component from l")
def components(repo, edge):
    return G.components(repo, edge.where("kind = 1"))


@query("component_summary", "repo", "edge", sql=COMPONENTS)
def component_summary(repo, edge):
    return G.component_summary(components(repo, edge))


@query("domain_modularity", "edge", "world", sql="""
with l as (select repo_id as id, domain as label from world where domain is not null),
b as (select src, dst, coalesce(weight, 1) as w from edge where src <> dst union all select dst, src, coalesce(weight, 1) from edge where src <> dst),
r as (select x.label a, y.label b, w from b join l x on x.id = src join l y on y.id = dst), p as (select a, sum(w) d, sum(case when a = b then w else 0 end) i from r group by 1)
select round(sum(i) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 9) as modularity from p
""")
def domain_modularity(edge, world):
    labels = world.where("domain is not null").select(F.col("repo_id").alias("id"), F.col("domain").alias("label"))
    return G.modularity(edge, labels).withColumn("modularity", F.round("modularity", 9))


@query("disconnected_domains", "edge", "world", sql="""
with recursive w as (select repo_id as id, domain as label from world where domain is not null),
i as (select distinct x.id a, y.id b from edge join w x on x.id = src join w y on y.id = dst where x.label = y.label and src <> dst), e as (select a, b from i union select b, a from i),
c(id, low) as (select id, id from w union select e.b, c.low from c join e on e.a = c.id where c.low < e.b), l as (select id, min(low) as component from c group by 1)
select label, count(distinct component) as parts, count(*) as size from l join w using (id) group by 1 having count(distinct component) > 1
""")
def disconnected_domains(edge, world):
    return G.disconnected_communities(edge, world.where("domain is not null").select(F.col("repo_id").alias("id"), F.col("domain").alias("label")))


@query("communities", "repo", "edge")
def communities(repo, edge):
    return G.communities(repo, edge.where("kind in (0, 1)"))


@query("packed_graph", "edge", sql="""
with w as (select src, dst, kind, weight from edge where src <> dst and weight is not null), m as (select min(weight) lo, max(weight) hi from w),
u as (select src, dst, kind, least(greatest(trunc((weight - lo) / (hi - lo) * 8191)::int, 0), 8191) | (kind << 13) as p from w, m)
select src as row, dst as target, (p | 32768)::int as packed from u union all select dst, src, p::int from u
""")
def packed_graph(edge):
    rows = edge.where("src <> dst and weight is not null").select("src", "dst", "kind", "weight")
    return G.packed_entries(G.unit_weights(rows))


@query("decoded_degrees", "edge", sql="""
select id, count(*) filter (o) as out_degree, count(*) filter (not o) as in_degree from (select src as id, true as o from edge where src <> dst and weight is not null union all select dst, false from edge where src <> dst and weight is not null) group by 1
""")
def decoded_degrees(edge):
    rows = G.decoded_entries(packed_graph(edge))
    return rows.groupBy(F.col("row").alias("id")).agg(F.count_if("outgoing").alias("out_degree"), F.count_if(~F.col("outgoing")).alias("in_degree"))


@query("focus_arcs", "edge", "rank_pair", sql="""
with c as (select distinct repo_a as id from rank_pair), e as (select src, dst, kind, weight from edge where kind <> 1 and src <> dst and weight is not null)
select c.id as centre, case when src = c.id then dst else src end as other, src = c.id as outgoing, kind, round(0.35 + 0.65 * weight, 9) as alpha from c join e on e.src = c.id or e.dst = c.id
""")
def focus_arcs(edge, pairs):
    rows = edge.where("kind <> 1 and src <> dst and weight is not null").select("src", "dst", "kind", F.round(0.35 + 0.65 * F.col("weight"), 9).alias("alpha"))
    ends = rows.select(F.col("src").alias("centre"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"), "kind", "alpha")
    ends = ends.unionByName(rows.select(F.col("dst").alias("centre"), F.col("src").alias("other"), F.lit(False).alias("outgoing"), "kind", "alpha"))
    return ends.join(pairs.select(F.col("repo_a").alias("centre")).distinct(), "centre", "left_semi")


@query("backbone", "edge", "world", sql="""
with recursive k as (select repo_id as id, rank from world where rank is not null), s as (select src, dst, coalesce(weight, 0) * sqrt(x.rank * y.rank) as score from edge join k x on x.id = src join k y on y.id = dst where src <> dst),
a as (select row_number() over (order by score desc, src, dst) as i, src, dst, score from s),
g(i, ends, pairs, taken) as (select 0::bigint, []::bigint[], []::varchar[], false union all
  select a.i, case when ok then list_concat(ends, [src, dst]) else ends end, case when ok then list_append(pairs, pair) else pairs end, ok from
  (select g.i as at, ends, pairs, a.*, least(src, dst) || '-' || greatest(src, dst) as pair, len(list_filter(ends, lambda e: e = src)) < 4 and len(list_filter(ends, lambda e: e = dst)) < 4 and not list_contains(pairs, least(src, dst) || '-' || greatest(src, dst)) as ok
   from g join a on a.i = g.i + 1 where len(pairs) < 900) a)
select src, dst, round(score, 9) as score from g join a using (i) where taken
""")
def backbone(edge, world):
    ranks = world.where("rank is not null").select(F.col("repo_id").alias("id"), "rank")
    return G.backbone(edge.select("src", "dst", "weight"), ranks).withColumn("score", F.round("score", 9))


@query("star_score_disagreement", "repo_signals", sql="""
with s as (select repo_id, coalesce(nullif(stars, 'nan'), 0) as s, coalesce(nullif(pagerank_ratio, 'nan'), 1) as p from repo_signals),
r as (select repo_id, row_number() over (order by s desc, repo_id) - row_number() over (order by p desc, repo_id) as delta from s)
select repo_id, delta from r order by abs(delta) desc, repo_id limit 50
""")
def star_score_disagreement(signals):
    rows = signals.select("repo_id", F.coalesce(F.nanvl("stars", F.lit(None)), F.lit(0.0)).alias("s"), F.coalesce(F.nanvl("pagerank_ratio", F.lit(None)), F.lit(1.0)).alias("p"))
    rows = global_positions(global_positions(rows, "s", F.col("repo_id"), out="a"), "p", F.col("repo_id"), out="b")
    return rows.select("repo_id", (F.col("a") - F.col("b")).alias("delta")).orderBy(F.desc(F.abs("delta")), "repo_id").limit(50)

"""SQL over the same tables for the training-data queries that SQL can express."""

from __future__ import annotations

SIGNALS = ("stars", "dependents", "pagerank_ratio", "stars_90d")


def _points() -> str:
    parts = [
        f"""(case when {s} is null or isnan({s}) then (count(*) filter ({s} is not null and not isnan({s})) over () + 1) / 2.0
        else rank() over (partition by coalesce(isnan({s}), true) order by {s})
           + (count(*) over (partition by coalesce(isnan({s}), true), {s}) - 1) / 2.0 end)"""
        for s in SIGNALS
    ]
    return "select repo_id as id, " + " + ".join(parts) + " as points from repo_signals"


P2_FOUND = """
with p as (select repo_id, sin(theta) * cos(phi) x, cos(theta) y, sin(theta) * sin(phi) z
           from world where theta is not null and phi is not null),
n as (select a.repo_id, list_sort(list(b.repo_id)) near from p a join p b
      on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= (2 * sin(0.0005)) ** 2 group by 1),
g as (select near, count(*) c from n group by 1)
select n.repo_id, n.near[1] as cluster_key from n join g using (near) where g.c = len(n.near) and g.c >= 5
"""

P3_FOUND = f"""
with s as ({_points()})
select repo_a, repo_b, case when a.points > b.points then repo_a when b.points > a.points then repo_b
       else least(repo_a, repo_b) end as higher_id
from (select distinct repo_a, repo_b from rank_pair) join s a on a.id = repo_a join s b on b.id = repo_b
"""

P3_RANKING = f"""
with s as ({_points()})
select id as repo_id, points::double as points, row_number() over (order by points desc, id) as position from s
"""

STRATA = """
select r.id, 's' || ((coalesce(r.stars, 0) >= 10)::int + (coalesce(r.stars, 0) >= 50)::int + (coalesce(r.stars, 0) >= 200)::int + (coalesce(r.stars, 0) >= 1000)::int
       + (coalesce(r.stars, 0) >= 5000)::int + (coalesce(r.stars, 0) >= 25000)::int) || '_d' || lpad(domain::varchar, 2, '0') || '_a'
       || ((days >= 30)::int + (days >= 180)::int + (days >= 730)::int) as stratum_key
from (select id, stars,
             coalesce(date_diff('microsecond', pushed_at, timestamp '2026-01-01') / 86400000000.0, 3650) as days from repo) r
join world w on w.repo_id = r.id where w.domain is not null
"""

P7_FOUND = f"""
with h as (select stratum_key, count(*) n from ({STRATA}) group by 1)
select t.stratum_key from stratum_target t left join h using (stratum_key)
where coalesce(h.n, 0) < greatest(t.min_count, floor(t.target_share * t.sample_size + 0.5))
"""

P10_FOUND = """
with d as (select doc_id, text from documents where length(text) >= 200),
g as (select distinct doc_id, substring(text, i, 200) s from (select doc_id, text, unnest(range(1, length(text) - 198)) i from d)),
m as (select s, list(doc_id) ids from g group by s having count(*) > 1),
u as (select distinct ids from (select list_sort(ids) ids from m)),
x as (select ids, unnest(ids) a from u)
select distinct a as doc_a, b as doc_b from (select a, unnest(ids) b from x) where a < b
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_ranking": P3_RANKING, "p7_found": P7_FOUND, "p10_found": P10_FOUND}

"""Text cleaning, hashing, full-text and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.functions import judgement as J
from stratlas.functions import text as T
from stratlas.operators import aggregates as A
from stratlas.operators import relational as R
from stratlas.operators import search as L
from stratlas.plans.registry import query

NOW = "2026-01-01 00:00:00"


@query("cleaned_readmes", "repo")
def cleaned_readmes(repo):
    return repo.select("id", T.cleaned(F.col("readme_raw"), F.col("description")).alias("c")).select("id", "c.*")


@query("embedding_inputs", "repo", sql="""
select id, concat_ws(chr(10), concat_ws(' — ', full_name, nullif(trim(description), '')),
  nullif(concat_ws(' ', 'Language: ' || nullif(trim(language), '') || '.', case when len(topics) > 0 then 'Topics: ' || array_to_string(topics[1:12], ', ') || '.' end), ''), nullif(trim(clean_text), '')) as text from repo
""")
def embedding_inputs(repo):
    return repo.select("id", T.embedding_input(*map(F.col, ("full_name", "description", "language", "topics", "clean_text"))).alias("text"))


@query("clamped_texts", "documents", sql="""
with h as (select doc_id, text, left(text, 300) as h from documents), p as (select *, strpos(reverse(h), ' ') as r from h)
select doc_id, case when length(text) <= 300 then text when r > 0 and 300 - r > 270 then left(h, 300 - r) else h end as head from p
""")
def clamped_texts(documents):
    return documents.select("doc_id", T.clamped(F.col("text"), 300).alias("head"))


@query("non_english_texts", "repo", sql=r"""
with c as (select id, len(regexp_extract_all(clean_text, '\p{L}')) as l, len(regexp_extract_all(clean_text, '[\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]')) as o from repo)
select id, l >= 40 and o > 0.25 * l as non_english from c where l is not null
""")
def non_english_texts(repo):
    return repo.where("clean_text is not null").select("id", T.non_english(F.col("clean_text")).alias("non_english"))


@query("text_hashes", "documents", sql="select doc_id, sha256(text) as hash from documents")
def text_hashes(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("path_parts", "documents", sql="""
select doc_id, split_part(full_name, '/', 1) as owner, split_part(full_name, '/', 2) as name, (length(full_name) - length(replace(full_name, '-', '')))::int as hyphens,
       regexp_extract(path, '\\.([a-z]+)$', 1) as suffix from documents
""".replace("\\\\", "\\"))
def path_parts(documents):
    return documents.select("doc_id", F.split_part("full_name", F.lit("/"), F.lit(1)).alias("owner"), F.split_part("full_name", F.lit("/"), F.lit(2)).alias("name"), (F.length("full_name") - F.length(F.replace("full_name", F.lit("-"), F.lit("")))).alias("hyphens"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("suffix"))


@query("url_names", "repo", sql="select id, full_name as name from repo where regexp_matches(full_name, '^[^/\\s]+/[^/\\s]+$')".replace("\\\\", "\\"))
def url_names(repo):
    url = F.concat(F.lit(" https://github.com/"), F.col("full_name"), F.lit("/ "))
    return repo.select("id", T.repo_of_url(url).alias("name")).where("name is not null")


@query("parsed_times", "repo", sql="select id, pushed_at::timestamp as pushed_at from repo")
def parsed_times(repo):
    text = F.concat(F.date_format("pushed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return repo.select("id", T.parse_iso(text).cast("timestamp_ntz").alias("pushed_at"))


@query("chosen_readmes", "repo", sql="""
with e as (select id, readme_raw as t from repo union all select id, clean_text from repo)
select repo.id, max(length(t)) filter (not (length(t) < 200 and not contains(t, chr(10)) and not contains(t, ' ')))::int as size from repo join e on e.id = repo.id group by 1
""")
def chosen_readmes(repo):
    entry = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("text"), F.lit(0o100644).alias("mode"))
    link = F.struct(F.lit("README").alias("name"), F.repeat(F.lit("long text "), F.lit(1000)).alias("text"), F.lit(0o120000).alias("mode"))
    return repo.select("id", T.chosen_readme(F.array(entry("README.md", "readme_raw"), entry("readme.rst", "clean_text"), link))["size"].alias("size"))


@query("judgements", "repo_signals", sql="""
select repo_id, least(100, greatest(0, coalesce(case when isnan(stars) then null else stars end, 0)))::double as maintenance, 'ok' as summary from repo_signals
""")
def judgements(signals):
    n = F.coalesce(F.nanvl("stars", F.lit(None)), F.lit(0.0))
    scores = F.concat_ws(", ", *[F.concat(F.lit(f'"{d}": '), n.cast("long").cast("string")) for d in J.DIMENSIONS])
    answer = F.concat(F.lit("<think>{}</think> first {\"a\": 1} then {"), scores, F.lit(', "summary": "ok", "flags": ["x"]} end'))
    return signals.select("repo_id", J.parsed(answer).alias("j")).select("repo_id", "j.maintenance", "j.summary")


SCORE = "(list_sum(list_transform(range(1, 1 + len(list_filter(t, lambda x: x = '{0}'))), lambda i: 1.0 / (i * i))))"
LEX = f"""
w as (select id, stars, list_filter(string_split_regex(regexp_replace(lower(concat_ws(' ', replace(full_name, '/', ' '), description)), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') as u from repo),
t as (select id, stars, list_transform(u, lambda x: case when x in ('cores', 'records', 'record') then 'record' when x in ('streaming') then 'stream' else x end) as t from w),
s as (select id, coalesce(stars, 0) as stars, round((coalesce({SCORE.format('record')}, 0) + coalesce({SCORE.format('stream')}, 0)) / 1.64493406685 / 2, 9) as score from t where list_has_any(t, ['record', 'stream'])),
"""
LEX = LEX.replace("('cores', 'records', 'record')", "('records', 'record')").replace("('streaming')", "('streaming', 'stream', 'streams', 'streamed')")
TEXT_QUERY = "records streaming"


@query("full_text", "repo", sql=f"with {LEX.rstrip().rstrip(',')} select id, score, row_number() over (order by score desc, stars desc, id)::int as r from s order by r limit 100")
def full_text(repo):
    return L.lexical(repo, TEXT_QUERY, 100)


@query("exact_names", "repo", sql="""
select id, row_number() over (order by coalesce(stars, 0) desc, id)::int as r from repo where lower(split_part(full_name, '/', 2)) = 'pogolopeva' or lower(full_name) = 'pogolopeva' order by r limit 100
""")
def exact_names(repo):
    return L.exact_name(repo, "Pogolopeva", 100).select("id", "r")


@query("fused_search", "repo", "repo_signals", sql=f"""with {LEX}
l as (select id, row_number() over (order by score desc, stars desc, id) as r from s qualify r <= 100),
e as (select id, row_number() over (order by coalesce(stars, 0) desc, id) as r from repo where lower(split_part(full_name, '/', 2)) = 'records streaming' and false),
d0 as (select repo_id as id, pagerank_ratio as score from repo_signals where pagerank_ratio is not null and not isnan(pagerank_ratio) order by round(pagerank_ratio, 9) desc, repo_id limit 100),
d as (select id, row_number() over (order by round(score + 0.1 * log10(1 + coalesce(stars, 0)), 9) desc, id) as r from d0 join (select id, stars from repo) using (id))
select id, round(sum(w / (60 + r)), 12) as score from (select id, r, 1.0 as w from l union all select id, r, 2.0 from d) group by 1 order by score desc, id limit 50""")
def fused_search(repo, signals):
    dense = signals.where("pagerank_ratio is not null and not isnan(pagerank_ratio)").select(F.col("repo_id").alias("id"), F.col("pagerank_ratio").alias("score"))
    dense = dense.orderBy(F.desc(F.round("score", 9)), "id").limit(100)
    return L.hybrid(repo, TEXT_QUERY, dense)


@query("approachable_search", "repo", "repo_signals", sql=f"""with {LEX}
l as (select id, row_number() over (order by score desc, stars desc, id) as r from s qualify r <= 100),
a as (select r.id from repo r join repo_signals g on g.repo_id = r.id where not coalesce(is_archived, false) and license is not null and pushed_at > timestamp '2024-01-01' and g.criticality >= 0.01 and not isnan(g.criticality))
select id, round(1.0 / (60 + r), 12) as score from l where id in (select id from a) order by score desc, id limit 50""")
def approachable_search(repo, signals):
    ease = signals.where(~F.isnan("criticality")).select(F.col("repo_id").alias("id"), F.col("criticality").alias("ease"))
    return L.hybrid(repo, TEXT_QUERY, None, 50, R.approachable(repo, ease, NOW, 0.01))


@query("search_recall", "repo", "rank_pair", sql="""
with e as (select 'q' || repo_a as query, b.full_name as name, b.stars as s from rank_pair join repo b on b.id = repo_a union select 'q' || repo_a, c.full_name, c.stars from rank_pair join repo c on c.id = repo_b),
r as (select *, row_number() over (partition by query order by s desc, name) as position from e),
h as (select query, avg((position <= 1)::int) as r from r group by 1) select round(avg(r), 6) as recall, count(*) filter (r = 0) as empty, count(*) as queries from h
""")
def search_recall(repo, pairs):
    names = repo.select("id", "full_name", "stars")
    ends = pairs.select(F.concat(F.lit("q"), F.col("repo_a").cast("string")).alias("query"), F.explode(F.array("repo_a", "repo_b")).alias("id"))
    rows = ends.join(names, "id").select("query", F.col("full_name").alias("name"), "stars").distinct()
    ranked = rows.withColumn("position", F.row_number().over(W.partitionBy("query").orderBy(F.col("stars").desc_nulls_last(), "name")))
    return A.recall_at_k(rows, ranked, 1)

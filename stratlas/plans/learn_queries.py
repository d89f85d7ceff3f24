"""Features, teaching samples, splits, boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratlas.operators import learn as B
from stratlas.plans.registry import query

NOW = "2026-01-01 00:00:00"
DAYS = "date_diff('microsecond', {0}, timestamp '2026-01-01') / 86400000000.0"


@query("features", "repo", sql=f"""
select id, coalesce(stars, 0)::double as stars, round(ln(1 + coalesce(stars, 0)), 9) as log_stars, round(coalesce({DAYS.format('pushed_at')}, -1), 6) as idle_days,
 round(greatest(-1e6, least(1e6, coalesce(coalesce(forks, 0) / nullif(coalesce(stars, 0), 0), 0))), 9) as fork_ratio, coalesce(length(readme_raw), 0)::double as readme_length,
 (coalesce(license, '') <> '')::int::double as has_license, coalesce(lower(trim(language)) = 'python', false)::int::double as language_python,
 (coalesce(lower(trim(language)), '') = '')::int::double as language_missing from repo""")
def features(repo):
    t = B.features(repo, NOW)
    return t.select("id", "stars", F.round("log_stars", 9).alias("log_stars"), F.round("idle_days", 6).alias("idle_days"), F.round("fork_ratio", 9).alias("fork_ratio"), "readme_length", "has_license", "language_python", "language_missing")


def _feature_sql() -> dict[str, str]:
    """Each feature in SQL."""
    n = lambda c: f"coalesce({c}, 0)::double"
    flag = lambda c: f"coalesce({c}, false)::int::double"
    size = lambda c: f"coalesce(length({c}), 0)::double"
    ratio = lambda a, b: f"greatest(-1e6, least(1e6, coalesce(coalesce({a}, 0) / nullif({b}, 0), 0)))"
    age, idle, language = DAYS.format("created_at"), DAYS.format("pushed_at"), "lower(trim(language))"
    out = {c: n(c) for c in ("stars", "stars_90d", "forks", "open_issues", "criticality", "clean_reduction")}
    out |= {c: flag(c) for c in ("is_fork", "is_archived", "low_signal", "non_english")}
    out |= {
        "log_stars": f"ln(1 + {n('stars')})", "age_days": f"coalesce({age}, -1)", "idle_days": f"coalesce({idle}, -1)", "fork_ratio": ratio(n("forks"), n("stars")), "issue_ratio": ratio(n("open_issues"), n("stars")),
        "velocity_ratio": ratio(n("stars_90d"), n("stars")), "stars_per_day": ratio(n("stars"), age), "readme_length": size("readme_raw"), "log_readme_length": f"ln(1 + {size('readme_raw')})", "clean_length": size("clean_text"),
        "description_length": size("description"), "name_length": size("full_name"), "name_hyphens": "(length(full_name) - length(replace(full_name, '-', '')))::double", "n_topics": "len(coalesce(topics, []))::double",
        "n_dropped": "len(coalesce(dropped_sections, []))::double", "has_license": "(coalesce(license, '') <> '')::int::double", "has_description": "(coalesce(description, '') <> '')::int::double",
        "code_share": ratio(f"{size('readme_raw')} - {size('clean_text')}", size("readme_raw")), "text_per_topic": ratio(size("clean_text"), "len(coalesce(topics, []))"), "never_pushed": "(pushed_at is null)::int::double",
        "description_share": ratio(size("description"), size("clean_text")), "issues_per_fork": ratio(n("open_issues"), n("forks")), "idle_share": ratio(idle, age),
        "language_missing": f"(coalesce({language}, '') = '')::int::double",
        "language_other": f"(coalesce({language}, '') <> '' and {language} not in ({', '.join(repr(x) for x in B.LANGUAGES)}))::int::double",
    }
    return out | {f"language_{B.plain_name(x)}": f"coalesce({language} = '{x}', false)::int::double" for x in B.LANGUAGES}


FEATURES = _feature_sql()


def _rounded(table):
    return table.select("id", *[F.round(f"`{c}`", 6).alias(c) for c in table.columns if c != "id"])


@query("all_features", "repo", sql="select id, " + ", ".join(f"round({x}, 6) as {c}" for c, x in FEATURES.items()) + " from repo")
def all_features(repo):
    return _rounded(B.features(repo, NOW))


VALUES = "f as materialized (select " + ", ".join(f"{x} as {c}" for c, x in FEATURES.items()) + " from repo)"


@query("feature_variances", "repo", sql=f"with {VALUES} " + " union all ".join(f"select '{c}' as feature, round(ln(1 + var_pop({c})), 6) as log_variance, var_pop({c}) = 0 as constant from f" for c in FEATURES))
def feature_variances(repo):
    rows = B.constants(B.features(repo, NOW))
    return rows.select("feature", F.round(F.log1p("variance"), 6).alias("log_variance"), (F.col("variance") == 0).alias("constant"))


HIDDEN = B.gives_popularity_away(list(FEATURES))


@query("blindfolded_features", "repo", sql="select id, " + ", ".join(f"round({x}, 6) as {c}" for c, x in FEATURES.items() if c not in HIDDEN) + " from repo")
def blindfolded_features(repo):
    return _rounded(B.blindfolded(B.features(repo, NOW)))


STRATA = f"""s as (select r.id, (coalesce(r.stars, 0) >= 10)::int + (coalesce(r.stars, 0) >= 50)::int + (coalesce(r.stars, 0) >= 200)::int + (coalesce(r.stars, 0) >= 1000)::int + (coalesce(r.stars, 0) >= 5000)::int + (coalesce(r.stars, 0) >= 25000)::int as s,
coalesce(w.domain, 0) as d, (x >= 30)::int + (x >= 180)::int + (x >= 730)::int as a from (select *, coalesce({DAYS.format('pushed_at')}, 3650) as x from repo) r left join (select repo_id, min(domain) as domain from world group by 1) w on w.repo_id = r.id)"""


@query("stratum_counts", "repo", "world", sql=f"with {STRATA} select s, d, a, count(*) as n from s group by 1, 2, 3")
def stratum_counts(repo, world):
    return B.teaching_strata(repo, world, NOW).groupBy("s", "d", "a").agg(F.count(F.lit(1)).alias("n"))


@query("teaching_sample", "repo", "world")
def teaching_sample(repo, world):
    return B.teaching_sample(B.teaching_strata(repo, world, NOW), max(1, repo.count() // 5))


@query("teaching_plan", "repo", "world", "repo_fetch")
def teaching_plan(repo, world, fetch):
    return teaching_sample(repo, world).join(fetch.select(F.col("repo_id").alias("id")), "id", "left_anti")


@query("train_test_split", "repo", "world", sql=f"""with {STRATA}, o as (select *, count(*) over (partition by s, d, a) as n, row_number() over (partition by s, d, a order by md5(id || '-42'), id) as r from s)
select id, n > 1 and r <= greatest(1, round_even(n * 0.2, 0)) as is_test from o""")
def train_test_split(repo, world):
    return B.split(B.teaching_strata(repo, world, NOW))


@query("split_sizes", "repo", "world", sql=f"with {STRATA}, n as (select s, d, a, count(*) n from s group by 1, 2, 3) select s, d, a, case when n > 1 then greatest(1, round_even(n * 0.2, 0)) else 0 end::bigint as test, n from n")
def split_sizes(repo, world):
    strata = B.teaching_strata(repo, world, NOW)
    rows = strata.join(B.split(strata), "id").groupBy("s", "d", "a")
    return rows.agg(F.count_if("is_test").alias("test"), F.count(F.lit(1)).alias("n"))


@query("coverage_report", "repo", "world")
def coverage_report(repo, world):
    strata = B.teaching_strata(repo, world, NOW)
    sample = B.teaching_sample(strata, max(1, repo.count() // 5)).groupBy("s", "d", "a").agg(F.count(F.lit(1)).alias("taken"))
    return strata.groupBy("s", "d", "a").agg(F.count(F.lit(1)).alias("n")).join(sample, ["s", "d", "a"], "left").na.fill(0, ["taken"])


def _targets(signals):
    value = F.coalesce(F.nanvl("pagerank_ratio", F.lit(None)), F.lit(0.0))
    return signals.select(F.col("repo_id").alias("id"), F.least(F.lit(100.0), 20 * F.log1p(value)).alias("target"))


@query("student_scores", "repo", "repo_signals")
def student_scores(repo, signals):
    table = B.features(repo, NOW)
    return B.predicted(table, B.train(table, _targets(signals), 4000))


@query("student_quality", "repo", "repo_signals")
def student_quality(repo, signals):
    targets = _targets(signals)
    base = targets.agg(F.avg("target")).first()[0]
    rows = student_scores(repo, signals).select("id", F.col("target").alias("guess")).join(targets, "id")
    return B.regression_scores(rows, "target", "guess", base or 0.0)


@query("binned_stars", "repo", sql="""
with t as (select id, coalesce(stars, 0)::double as stars, coalesce(length(readme_raw), 0)::double as readme_length from repo),
e as (select list_distinct(list_transform(quantile_cont(stars, (select list(i / 64.0 order by i) from range(1, 64) r(i))), lambda x: round(x, 6))) as s, list_distinct(list_transform(quantile_cont(readme_length, (select list(i / 64.0 order by i) from range(1, 64) r(i))), lambda x: round(x, 6))) as l from t)
select id, len(list_filter(s, lambda x: x <= stars))::int as stars_bin, len(list_filter(l, lambda x: x <= readme_length))::int as readme_bin from t, e
""".replace("(select list(i / 64.0 order by i) from range(1, 64) r(i))", "[" + ", ".join(f"{i / 64}" for i in range(1, 64)) + "]"))
def binned_stars(repo):
    table = B.features(repo, NOW).select("id", "stars", "readme_length")
    edges = B.bin_edges(table, ["stars", "readme_length"])
    bins = lambda c: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[c]]), lambda e: e <= F.col(c)))
    return table.select("id", bins("stars").alias("stars_bin"), bins("readme_length").alias("readme_bin"))

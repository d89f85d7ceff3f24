"""Projections, predicates and joins over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlas.functions.bands import days_before

DEPENDS, SIMILAR, USED_WITH = 0, 1, 2


def needs_embedding(repo: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with signal and input text whose embedding is missing or made from other content, most stars first."""
    hashes = done.select(F.col("id").alias("done_id"), "embedded_hash")
    rows = repo.join(hashes, repo.id == F.col("done_id"), "left").drop("done_id")
    rows = rows.where(~F.coalesce("low_signal", F.lit(False)) & (F.coalesce(F.length("embedding_input"), F.lit(0)) > 0))
    rows = rows.where(~F.col("embedded_hash").eqNullSafe(F.col("content_hash")))
    rows = rows.orderBy(F.col("stars").desc_nulls_last(), "id")
    return rows.limit(limit) if limit else rows


def teacher_candidates(repo: DataFrame, world: DataFrame, now: str) -> DataFrame:
    """Rows with signal and text: stars and domain default to 0, days since the push to 3650."""
    place = world.select(F.col("repo_id").alias("id"), "domain")
    rows = repo.where(~F.coalesce("low_signal", F.lit(False)) & (F.coalesce(F.length("clean_text"), F.lit(0)) > 0)).join(place, "id", "left")
    days = F.coalesce(days_before("pushed_at", now), F.lit(3650.0))
    return rows.select("id", "full_name", F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("domain", F.lit(0)).alias("domain"), F.round(days, 6).alias("days_since_push"))


def text_lengths(repo: DataFrame) -> DataFrame:
    """Ids with the lengths of their texts; the texts stay in the scan."""
    zero = F.lit(0)
    return repo.select("id", F.coalesce(F.length("readme_raw"), zero).alias("readme_length"), F.coalesce(F.length("clean_text"), zero).alias("clean_length"), F.size(F.coalesce("topics", F.array())).alias("n_topics"))


def approachable(repo: DataFrame, ease: DataFrame, now: str, least: float = 50.0) -> DataFrame:
    """Not archived, licensed (an empty licence passes), pushed within two years, ease of onboarding known and high enough."""
    since = F.expr(f"timestamp '{now}' - interval 2 years")
    rows = repo.where(~F.coalesce("is_archived", F.lit(False)) & F.col("license").isNotNull() & (F.col("pushed_at").cast("timestamp") > since))
    return rows.join(ease.where(F.col("ease") >= least), "id")


def suspect_readme(repo: DataFrame) -> DataFrame:
    """READMEs that look like a path: short, one line, no blank, with a slash or dot."""
    t = F.col("readme_raw")
    return repo.where((F.length(t) > 0) & (F.length(t) < 200) & ~t.contains("\n") & ~t.contains(" ") & (t.contains("/") | t.contains(".")))


def by_names(repo: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose name, in any case, is in ``names`` (a semi join; names may be many)."""
    wanted = names.select(F.lower("full_name").alias("wanted")).distinct()
    return repo.join(wanted, F.lower(repo.full_name) == F.col("wanted"), "left_semi")


def detail(repo: DataFrame) -> DataFrame:
    """What a project page shows: no summary where there is no signal, blank summaries are none."""
    text = F.nullif(F.trim("description"), F.lit(""))
    summary = F.when(F.col("low_signal"), F.lit(None).cast("string")).otherwise(text)
    return repo.select("id", "full_name", summary.alias("summary"), F.split_part("full_name", F.lit("/"), F.lit(1)).alias("owner"), F.split_part("full_name", F.lit("/"), F.lit(2)).alias("name"))


def rankable_edges(edge: DataFrame) -> DataFrame:
    """Dependency and co-use edges with the weight that ranks: ppmi where it is known."""
    return edge.where(F.col("kind").isin(DEPENDS, USED_WITH)).select("src", "dst", "kind", F.coalesce("ppmi", "weight").alias("weight"))


def resolve_names(pairs: DataFrame, repo: DataFrame, fold_case: bool = True) -> DataFrame:
    """``(src_name, dst_name, …)`` to ids by two equi-joins; unknown names and self-edges drop out."""
    key: Column = F.lower("full_name") if fold_case else F.col("full_name")
    ids = repo.groupBy(key.alias("key")).agg(F.min("id").alias("id"))
    fold = F.lower if fold_case else (lambda c: c)
    rows = pairs.join(ids.select(F.col("key").alias("k1"), F.col("id").alias("src")), fold(F.col("src_name")) == F.col("k1"))
    rows = rows.join(ids.select(F.col("key").alias("k2"), F.col("id").alias("dst")), fold(F.col("dst_name")) == F.col("k2"))
    return rows.where("src <> dst").drop("k1", "k2", "src_name", "dst_name")


def unmatched_names(pairs: DataFrame, repo: DataFrame) -> DataFrame:
    """How many edges have both ends, one or none in the catalogue."""
    ids = repo.select(F.lower("full_name").alias("key")).distinct()
    rows = pairs.join(ids.withColumnRenamed("key", "k1"), F.lower("src_name") == F.col("k1"), "left")
    rows = rows.join(ids.withColumnRenamed("key", "k2"), F.lower("dst_name") == F.col("k2"), "left")
    known = F.col("k1").isNotNull().cast("int") + F.col("k2").isNotNull().cast("int")
    return rows.groupBy(known.alias("ends_known")).agg(F.count(F.lit(1)).alias("edges"))


def package_edges(requirements: DataFrame, packages: DataFrame) -> DataFrame:
    """Requirement rows between packages to edges between repositories, weighted by the number of versions.

    Both packages must be mapped; names are compared in lower case; a repository doesn't depend on itself.
    """
    own = packages.select(F.lower("ecosystem").alias("e"), F.lower("name").alias("n"), "repo_id").distinct()
    rows = requirements.select(F.lower("ecosystem").alias("e"), F.lower("name").alias("a"), F.lower("requires").alias("b"))
    rows = rows.join(own.select("e", F.col("n").alias("a"), F.col("repo_id").alias("src")), ["e", "a"])
    rows = rows.join(own.select("e", F.col("n").alias("b"), F.col("repo_id").alias("dst")), ["e", "b"])
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def first_by(rows: DataFrame, key: str, order: list[Column], *keep: str) -> DataFrame:
    """The first row of each key in an order, as one aggregation with map-side combination (no window, no lateral join)."""
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("s"))
    return picked.select(key, "s.*")


def enrich(repo: DataFrame, rank: DataFrame, place: DataFrame, signals: DataFrame) -> DataFrame:
    """Three left joins on the id; each side is reduced to its needed columns first."""
    rows = repo.select("id", "full_name", "stars")
    rows = rows.join(rank.select(F.col("repo_id").alias("id"), "dependents"), "id", "left")
    rows = rows.join(place.select(F.col("repo_id").alias("id"), "theta", "phi", "domain"), "id", "left")
    return rows.join(signals.select(F.col("repo_id").alias("id"), "pagerank_ratio"), "id", "left")


def valid_scores(scores: DataFrame, repo: DataFrame) -> DataFrame:
    """The scores that still stand: made of the content that the project has now, or of one that wasn't noted (``scored_hash`` null)."""
    now = repo.where("id is not null").groupBy(F.col("id").alias("repo_id")).agg(F.max("content_hash").alias("__now"))
    return scores.join(now, "repo_id").where(F.col("scored_hash").isNull() | (F.col("scored_hash") == F.col("__now"))).drop("__now")


def alternatives(edge: DataFrame, ids: DataFrame, most: int = 200, kind: int = 1) -> DataFrame:
    """``(centre, other, weight)``: of each centre's ``most`` strongest neighbours of any kind those of ``kind``; ties by id and kind.

    The bound on row_number is applied before the shuffle, so a hub sends few rows.
    """
    from pyspark.sql.window import Window as W

    rows = edge.where("src <> dst and weight is not null").select("src", "dst", "kind", "weight")
    ends = rows.select(F.col("src").alias("centre"), F.col("dst").alias("other"), "kind", "weight").unionByName(rows.select(F.col("dst").alias("centre"), F.col("src").alias("other"), "kind", "weight"))
    near = ends.join(ids.select(F.col("id").alias("centre")).distinct(), "centre", "left_semi").groupBy("centre", "other", "kind").agg(F.max("weight").alias("weight"))
    order = W.partitionBy("centre").orderBy(F.desc("weight"), "other", "kind")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).where(F.col("kind") == kind).select("centre", "other", "weight")


def identities(ordered: DataFrame) -> DataFrame:
    """``(ordinal, org, name, full_name)`` of ``(position, full_name)`` rows: the name parted at its first slash, or, where there is none, one made of the ordinal."""
    made = F.concat(F.lit("project-"), F.substring(F.md5(F.col("position").cast("string")), 1, 6))
    named = F.length(F.trim("full_name")) > 0
    slash = F.instr("full_name", "/")
    org = F.when(~named | named.isNull(), F.lit("unnamed")).when(slash > 1, F.substring("full_name", F.lit(1), slash - 1)).otherwise(F.lit(""))
    name = F.when(~named | named.isNull(), made).when(slash > 1, F.substring("full_name", slash + 1, F.length("full_name"))).otherwise(F.col("full_name"))
    rows = ordered.select(F.col("position").alias("ordinal"), org.alias("org"), name.alias("name"))
    return rows.withColumn("full_name", F.when(F.col("org") == "", F.col("name")).otherwise(F.concat_ws("/", "org", "name")))


def neighbourhood(edge: DataFrame, repo: DataFrame, ids: DataFrame, kinds: tuple[int, ...], depth: int = 1, limit: int = 500) -> DataFrame:
    """Edges at up to ``depth`` hops around each of ``ids``, the ``limit`` heaviest per centre, with both names.

    ``(centre, src, dst, kind, weight, src_name, dst_name)``; ties go to the smaller ends.
    """
    from pyspark.sql.window import Window as W

    edges = edge.where(F.col("kind").isin(*kinds)).groupBy("src", "dst", "kind").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    both = edges.select("*", F.col("src").alias("at")).unionByName(edges.where("src <> dst").select("*", F.col("dst").alias("at")))
    seen = ids.select(F.col("id").alias("centre"), F.col("id").alias("at")).distinct()
    parts = []
    for _ in range(depth):
        reached = seen.join(both, "at").select("centre", "src", "dst", "kind", "weight").distinct()
        parts.append(reached)
        ends = reached.select("centre", F.explode(F.array("src", "dst")).alias("at"))
        seen = seen.unionByName(ends).distinct()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part).distinct()
    order = W.partitionBy("centre").orderBy(F.col("weight").desc(), "src", "dst", "kind")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")
    names = repo.select("id", "full_name")
    found = found.join(names.select(F.col("id").alias("src"), F.col("full_name").alias("src_name")), "src", "left")
    return found.join(names.select(F.col("id").alias("dst"), F.col("full_name").alias("dst_name")), "dst", "left")

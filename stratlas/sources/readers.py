"""Readers: captured API pages, criticality dumps, event months, requirement tables, name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.functions.text import parse_iso, repo_of_url

NODE = (
    "nameWithOwner string, description string, stargazerCount int, forkCount int, isFork boolean, isArchived boolean, pushedAt string, createdAt string, "
    "primaryLanguage struct<name: string>, licenseInfo struct<spdxId: string>, issues struct<totalCount: int>, "
    "repositoryTopics struct<nodes: array<struct<topic: struct<name: string>>>>"
)


def graph_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured search pages (JSON lines, one node each) to catalogue rows; nested nulls give nulls, topics an empty array."""
    return nodes_to_rows(spark.read.schema(NODE).json(path))


def nodes_to_rows(nodes: DataFrame) -> DataFrame:
    topics = F.filter(F.transform(F.coalesce("repositoryTopics.nodes", F.array()), lambda n: n["topic"]["name"]), lambda t: t.isNotNull())
    return nodes.where("nameWithOwner is not null").select(
        F.col("nameWithOwner").alias("full_name"), "description", F.col("primaryLanguage.name").alias("language"), topics.alias("topics"),
        F.col("stargazerCount").alias("stars"), F.col("forkCount").alias("forks"), F.col("issues.totalCount").alias("open_issues"),
        F.col("licenseInfo.spdxId").alias("license"), F.col("isFork").alias("is_fork"), F.col("isArchived").alias("is_archived"),
        parse_iso(F.col("pushedAt")).alias("pushed_at"), parse_iso(F.col("createdAt")).alias("created_at"),
    )


class BadDump(ValueError):
    """A criticality dump lacks a column."""


def criticality_strict(spark: SparkSession, path: str) -> DataFrame:
    """``(full_name, score)`` in lower case from a dump with ``repo.url`` and ``default_score``.

    A missing column, or while running a score outside 0…1, raises; unreadable scores and other addresses are left out.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in ("repo.url", "default_score") if c not in rows.columns]
    if missing:
        raise BadDump(f"no columns {missing}")
    score = F.col("default_score").try_cast("double")
    named = rows.select(F.lower(repo_of_url(F.col("`repo.url`"))).alias("full_name"), score.alias("score")).where("full_name is not null and score is not null")
    checked = F.when((F.col("score") >= 0) & (F.col("score") <= 1), F.col("score")).otherwise(F.raise_error(F.lit("score outside 0…1")).cast("double"))
    return named.withColumn("score", checked).groupBy("full_name").agg(F.max("score").alias("score"))


def criticality_lenient(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``(full_name, score)`` in the dump's casing, for wanted names only; either of two spellings of the columns will do."""
    rows = spark.read.option("header", True).csv(path)
    pick = lambda *names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in rows.columns], F.lit(None).cast("string"))
    named = rows.select(repo_of_url(pick("repo.url", "url")).alias("full_name"), pick("default_score", "criticality_score").try_cast("double").alias("score"))
    names = wanted.select(F.lower("full_name").alias("w")).distinct()
    return named.where("full_name is not null and score is not null").join(names, F.lower("full_name") == F.col("w"), "left_semi")


def event_months(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Watch events of a range of months from a table partitioned by ``month`` (yyyymm): other months aren't read."""
    return spark.read.parquet(path).where(F.col("month").between(first, last) & (F.col("type") == "WatchEvent"))


def package_map(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct ``(ecosystem, name, full_name)`` of packages with a code host project, lower-cased but for the name."""
    out = rows.where("ProjectType = 'GITHUB' and ProjectName is not null").select(F.lower("System").alias("ecosystem"), F.col("Name").alias("name"), F.lower("ProjectName").alias("full_name")).distinct()
    return out if names is None else out.join(names.select(F.lower("full_name").alias("full_name")).distinct(), "full_name", "left_semi")


def requirements(tables: dict[str, DataFrame]) -> DataFrame:
    """``(ecosystem, name, version, requires)`` of tables with an array ``dependencies<name, optional, kind>``.

    Optional dependencies don't count, nor those of another kind than runtime where a kind is given.
    """
    out = None
    for ecosystem, rows in sorted(tables.items()):
        flat = rows.select(F.lit(ecosystem).alias("ecosystem"), "name", "version", F.explode("dependencies").alias("d"))
        flat = flat.where(~F.coalesce("d.optional", F.lit(False)) & (F.coalesce("d.kind", F.lit("runtime")) == "runtime"))
        flat = flat.select("ecosystem", "name", "version", F.col("d.name").alias("requires"))
        out = flat if out is None else out.unionByName(flat)
    return out


def names_of_files(spark: SparkSession, path: str) -> DataFrame:
    """``(full_name, file, pos)`` of JSON files that hold an array of names; entries without a slash are none."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", "array<string>").alias("names"))
    return rows.select("file", F.posexplode("names").alias("pos", "full_name")).where(F.col("full_name").contains("/"))


def scan_bytes(df: DataFrame) -> int:
    """How many bytes the plan's inputs hold by Spark's own estimate, to check against a limit before running."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class TooCostly(ValueError):
    """A plan would read more than allowed."""


def within_budget(df: DataFrame, most: int) -> DataFrame:
    size = scan_bytes(df)
    if size > most:
        raise TooCostly(f"{size:,} bytes are more than {most:,}")
    return df

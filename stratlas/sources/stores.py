"""Fetching pages by name, seeding a store, probing tables, tables of names."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_QUERY = 25


def aliased_query(names: list[tuple[str, str]]) -> str:
    """One question for many pages: each ``(owner/name, path)`` under an alias of its own."""
    parts = []
    for i, (full_name, path) in enumerate(names):
        owner, _, name = full_name.partition("/")
        parts.append(f"r{i}: repository(owner: {json.dumps(owner)}, name: {json.dumps(name)}) {{ page: object(expression: {json.dumps('HEAD:' + path)}) {{ ... on Blob {{ text }} }} }}")
    return "query { " + " ".join(parts) + " }"


def answers(names: list[tuple[str, str]], data: dict) -> list[tuple[str, str]]:
    """``(full_name, text)`` of the pages that an aliased answer holds; missing and empty ones fall away."""
    out = []
    for i, (full_name, _) in enumerate(names):
        text = ((data.get(f"r{i}") or {}).get("page") or {}).get("text")
        if text and text.strip():
            out.append((full_name, text))
    return out


def fetch_pages(wanted: DataFrame, post: Callable[[str], dict], per_query: int = PER_QUERY) -> DataFrame:
    """``(full_name, readme_raw)`` of ``(full_name, path)`` rows, ``per_query`` in a question; a question that fails is skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(zip(batch["full_name"], batch["path"]))
            found = []
            for at in range(0, len(pairs), per_query):
                part = pairs[at : at + per_query]
                try:
                    found += answers(part, post(aliased_query(part)))
                except (ConnectionError, TimeoutError, ValueError):
                    continue
            yield pd.DataFrame(found, columns=["full_name", "readme_raw"])

    rows = wanted.select("full_name", F.coalesce("path", F.lit("README.md")).alias("path")).where(F.col("full_name").contains("/"))
    return rows.mapInPandas(run, "full_name string, readme_raw string")


def backfill(names: DataFrame, repo: DataFrame, post: Callable[[str], dict], path: str, every: int = 2000) -> DataFrame:
    """Pages of the named projects that the catalogue lacks content of, fetched in slices of about ``every`` and appended to ``path``.

    What an earlier run appended isn't fetched again.
    """
    spark = names.sparkSession
    done = repo.where("content_hash is not null").select(F.lower("full_name").alias("k"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "full_name string, readme_raw string"
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        done = done.unionByName(spark.read.schema(schema).parquet(path).select(F.lower("full_name").alias("k")))
    todo = names.groupBy(F.lower("full_name").alias("k")).agg(F.min_by(F.struct("full_name", "path"), "full_name").alias("s")).join(done.distinct(), "k", "left_anti").select("s.*")
    slices = max(1, -(-todo.count() // every))
    for i in range(slices):
        fetch_pages(todo.where(F.pmod(F.xxhash64("full_name"), F.lit(slices)) == i), post).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def seed(rows: DataFrame, write: Callable[[list[tuple]], None], batch: int = 500) -> None:
    """Hand ``(id, packed float32 bytes)`` rows to a store as ``(id, vector)``, ``batch`` at a time from each task; the store must take repeats."""

    def send(part: Iterator) -> None:
        held: list[tuple] = []
        for row in part:
            raw = bytes(row[1])
            held.append((row[0], list(struct.unpack(f"<{len(raw) // 4}f", raw))))
            if len(held) == batch:
                write(held)
                held = []
        if held:
            write(held)

    rows.where(f"{rows.columns[0]} is not null and {rows.columns[1]} is not null").foreachPartition(send)


def seed_folder(rows: DataFrame, path: str) -> DataFrame:
    """The drop-and-recreate form of ``seed`` for a store that is a folder."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def probe(spark: SparkSession, path: str, sample: int = 20) -> tuple[DataFrame, list[str]]:
    """``(column, type, nullable)`` of a table, nested fields by their paths, and a few rows as JSON: nothing but those is read."""
    df = spark.read.parquet(path)
    rows: list[tuple[str, str, bool]] = []

    def walk(prefix: str, schema) -> None:
        for field in schema.fields:
            rows.append((prefix + field.name, field.dataType.simpleString(), field.nullable))
            inner = getattr(field.dataType, "elementType", field.dataType)
            if hasattr(inner, "fields"):
                walk(f"{prefix}{field.name}.", inner)

    walk("", df.schema)
    return spark.createDataFrame(rows, "column string, type string, nullable boolean"), df.limit(sample).toJSON().collect()


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``(table, bytes, files)`` of the tables in a folder, from the file system alone."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    rows = []
    for entry in fs.listStatus(path):
        summary = fs.getContentSummary(entry.getPath())
        rows.append((entry.getPath().getName().removesuffix(".parquet"), summary.getLength(), summary.getFileCount()))
    return spark.createDataFrame(rows, "table string, bytes long, files long")


def names_table(names: DataFrame, view: str) -> DataFrame:
    """Names in lower case, each once, as a view to be joined by key: a list of names in a filter is tested name by name."""
    one = names.select(F.lower(F.trim("full_name")).alias("full_name")).where("full_name <> ''").distinct()
    one.createOrReplaceTempView(view)
    return one

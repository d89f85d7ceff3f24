"""A model as a teacher: judgements asked for concurrently, in slices that are kept as they come.

The call is handed in, so that everything around it runs and is tested without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlas.functions.judgement import DIMENSIONS, POPULARITY, parse, prompt
from stratlas.sources.clients import with_retries

ANSWER = "id long, " + ", ".join(f"{d} double" for d in DIMENSIONS) + ", summary string, flags array<string>, failure string"


class Leak(ValueError):
    """A question that gives the project's popularity away."""


def checked(question: str) -> str:
    """The question, unless a line of it names a count that gives popularity away (``stars: 5``)."""
    for line in question.lower().split("\n"):
        name, colon, rest = line.partition(":")
        if colon and name.strip() in POPULARITY and any(c.isdigit() for c in rest):
            raise Leak(line)
    return question


def judge(question: str, ask: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> dict:
    """One judgement, or a row that only says why there is none: a failure costs this row and nothing else."""
    try:
        answer = parse(with_retries(lambda: ask(checked(question)), sleep=sleep))
        return answer | {"failure": None} if answer else {"failure": "unparseable"}
    except Exception as failure:
        return {"failure": type(failure).__name__}


def judgements(rows: DataFrame, ask: Callable[[str], str], concurrency: int = 8) -> DataFrame:
    """``(id, dimensions, summary, flags, failure)`` of rows with id, full_name, description, clean_text."""
    names = ["id", *DIMENSIONS, "summary", "flags", "failure"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as workers:
            for batch in batches:
                done = list(workers.map(lambda q: judge(q, ask), batch["question"]))
                yield pd.DataFrame([{**dict.fromkeys(names), "id": i, **d} for i, d in zip(batch["id"], done)], columns=names)

    asked = rows.select(F.col("id").cast("long").alias("id"), prompt(F.col("full_name"), F.col("description"), F.coalesce("clean_text", F.lit(""))).alias("question"))
    return asked.where("id is not null and question is not null").mapInPandas(run, ANSWER)


def teach(rows: DataFrame, ask: Callable[[str], str], path: str, every: int = 200, concurrency: int = 8) -> DataFrame:
    """The table of judgements at ``path`` after the rows it lacks were asked for, about ``every`` of them at a time.

    Each slice is appended when it is done, so a run that dies loses at most one slice, and the next run asks for
    the rest only. Rows whose question failed are in the table with their failure, and are asked for again.
    """
    spark = rows.sparkSession
    before = known(spark, path)
    todo = rows if before is None else rows.join(before.where("failure is null").select("id"), "id", "left_anti")
    slices = max(1, -(-todo.count() // every))
    number = F.pmod(F.xxhash64("id"), F.lit(slices))
    for i in range(slices):  # a paid call for each row: the slices are few beside their cost
        judgements(todo.where(number == i), ask, concurrency).write.mode("append").parquet(path)
    return known(spark, path)


def known(spark: SparkSession, path: str) -> DataFrame | None:
    """The judgements so far, each id once: one that worked counts for more than a failure. None before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(ANSWER).parquet(path)
    rest = [c for c in rows.columns if c != "id"]
    best = F.min_by(F.struct(*rest), F.struct(F.col("failure").isNotNull(), F.col("summary"), F.col("failure")))
    return rows.groupBy("id").agg(best.alias("s")).select("id", "s.*")


def label_matrix(ids: DataFrame, scores: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``(id, dimensions, rated)``: the scores of each id; those never rated stay null, for "not read" isn't "average"."""
    known_ = scores.where(" and ".join(f"{d} is not null" for d in dimensions)).select("id", *dimensions, F.lit(True).alias("hit"))
    return ids.select("id").distinct().join(known_, "id", "left").select("id", *dimensions, F.coalesce("hit", F.lit(False)).alias("rated"))


def composite(scores: DataFrame, kept: list[str]) -> DataFrame:
    """``(id, composite)``: the plain mean of the kept dimensions that a row has; null where it has none or none is kept."""
    there = F.filter(F.array(*[F.col(d).cast("double") for d in kept]), lambda x: x.isNotNull()) if kept else F.array().cast("array<double>")
    return scores.select("id", F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).alias("composite"))


def estimate(rows: int, characters: float, per_minute: float, concurrency: int, per_million_in: float = 0.0, per_million_out: float = 0.0) -> dict[str, float]:
    """Tokens, cost and minutes of judging so many rows; a service that bills nothing costs nothing.

    A page's characters are 3.5 to a token, its question's frame is 900 tokens and an answer 120. The rate limit sets the
    pace; without one each worker makes a call a second.
    """
    tokens_in, tokens_out = rows * (characters / 3.5 + 900), rows * 120.0
    cost = tokens_in / 1e6 * per_million_in + tokens_out / 1e6 * per_million_out
    minutes = rows / per_minute if per_minute > 0 else rows / max(concurrency, 1) / 60
    return {"rows": rows, "tokens_in": int(tokens_in), "tokens_out": int(tokens_out), "cost": round(cost, 2), "minutes": round(minutes, 1)}

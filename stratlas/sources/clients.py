"""Clients of outside services: paging, token pools, rate limits, retries, and a Spark source over captured pages.

Network calls are a function handed in, so that everything around them runs and is tested without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratlas.sources.readers import NODE, nodes_to_rows


@dataclass
class PageSize:
    """Halves on a server's failure (not under ``least``), doubles after ``clean`` good answers."""

    size: int = 50
    least: int = 5
    most: int = 100
    clean: int = 5
    good: int = 0

    def failed(self) -> int:
        self.size, self.good = max(self.least, self.size // 2), 0
        return self.size

    def worked(self) -> int:
        self.good += 1
        if self.good >= self.clean:
            self.size, self.good = min(self.most, self.size * 2), 0
        return self.size


@dataclass
class TokenPool:
    """Tokens in turn; spent ones (``spare`` calls or fewer left) are skipped until they reset."""

    tokens: list[str]
    spare: int = 100
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    left: dict[str, tuple[int, float]] = field(default_factory=dict)
    turn: int = 0

    def take(self) -> str:
        if not self.tokens:
            raise ValueError("no tokens")
        while True:
            now = self.clock()
            for _ in self.tokens:
                token = self.tokens[self.turn % len(self.tokens)]
                self.turn += 1
                remaining, reset = self.left.get(token, (self.spare + 1, 0.0))
                if remaining > self.spare or reset <= now:
                    return token
            self.sleep(max(0.0, min(reset for _, reset in self.left.values()) - now))

    def seen(self, token: str, remaining: int, reset: float) -> None:
        self.left[token] = (remaining, reset)


@dataclass
class RateLimiter:
    """At most ``per_minute`` starts in any minute."""

    per_minute: int
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    starts: list[float] = field(default_factory=list)

    def wait(self) -> None:
        now = self.clock()
        self.starts = [t for t in self.starts if now - t < 60]
        if len(self.starts) >= self.per_minute:
            self.sleep(60 - (now - self.starts[0]))
            now = self.clock()
        self.starts.append(now)


def with_retries(call: Callable[[], object], tries: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: 0.5):
    """The call's result; a failure waits twice as long each time, by half at random, and the last one is raised."""
    for n in range(tries):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if n == tries - 1:
                raise
            sleep(base * 2**n * (0.5 + jitter() / 2))
    return None


def pages(fetch: Callable[[str, int, str | None], tuple[list, str | None]], query: str, most: int = 1000, cursor: str | None = None) -> Iterator[tuple[list, str | None]]:
    """``(nodes, cursor)`` of a search, at most ``most`` nodes; the page size follows the server."""
    size, seen, turns = PageSize(), 0, 0
    while seen < most and turns < most:
        turns += 1
        try:
            nodes, cursor = fetch(query, min(size.size, most - seen), cursor)
        except ConnectionError:
            if size.size == size.least:
                raise
            size.failed()
            continue
        size.worked()
        seen += len(nodes)
        yield nodes, cursor
        if not cursor or not nodes:
            return


class _Shard(InputPartition):
    def __init__(self, query: str, path: str):
        self.query, self.path = query, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.queries = json.loads(options["queries"])

    def partitions(self) -> list[InputPartition]:
        return [_Shard(q, self.path) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import os
        from urllib.parse import quote

        name = os.path.join(partition.path, quote(partition.query, safe="") + ".jsonl")
        if os.path.exists(name):
            with open(name, encoding="utf-8") as file:
                for line in file:
                    if line.strip():
                        yield (partition.query, line.strip())


class CapturedSearch(DataSource):
    """A Spark source of captured search answers: a partition per query, read where it runs."""

    @classmethod
    def name(cls) -> str:
        return "captured_search"

    def schema(self) -> str:
        return "query string, node string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def captured_search(spark: SparkSession, path: str, queries: list[str]) -> DataFrame:
    """Catalogue rows of captured answers; a repository that several queries found comes once."""
    spark.dataSource.register(CapturedSearch)
    raw = spark.read.format("captured_search").option("queries", json.dumps(queries)).load(path)
    return nodes_to_rows(raw.select(F.from_json("node", NODE).alias("n")).select("n.*")).dropDuplicates(["full_name"])


def hashed_embedding(text: str, width: int) -> np.ndarray:
    """A deterministic stand-in for an embedding service: signed hashes of words, at unit length."""
    import zlib

    v = np.zeros(width, np.float32)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        v[h % width] += 1.0 if h & 0x80000000 else -1.0
    size = float(np.linalg.norm(v))
    return v / size if size else v


def embed(rows: DataFrame, id_col: str, text_col: str, width: int = 64, batch: int = 128, client: Callable[[list[str]], list] | None = None) -> DataFrame:
    """``(id, v)``: texts sent in batches; an answer of another length than the question raises. Null and blank texts get none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part["t"].tolist()
                answer = client(texts) if client else [hashed_embedding(t, width) for t in texts]
                if len(answer) != len(texts) or any(len(v) != width for v in answer):
                    raise ValueError("the answer doesn't fit the question")
                yield pd.DataFrame({"id": part["id"], "v": [list(map(float, v)) for v in answer]})

    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.length(F.trim("t")) > 0)
    return texts.mapInPandas(run, "id long, v array<float>")


def not_yet_embedded(rows: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id the vector table lacks: what is left to send after a run that ended early."""
    return rows.join(vectors.select(F.col("id").alias(id_col)), id_col, "left_anti")


def extend_vectors(vectors: DataFrame, fresh: DataFrame, width: int) -> DataFrame:
    """The vector table with fresh vectors laid over it by id; vectors of another width raise."""
    from stratlas.operators.mutation import merge_upsert
    from stratlas.operators.vectors import check_width

    return merge_upsert(vectors, check_width(fresh, "v", width), ["id"])

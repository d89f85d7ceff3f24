"""Control plane: search shards, cost estimates, reports' verdicts, next steps."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_shards(low: int = 50, high: int = 400_000, factor: float = 1.35) -> list[tuple[int, int]]:
    """Star ranges, narrow where projects are many: each begins after the last and is ``factor`` times as high."""
    out, at = [], low
    while at <= high:
        end = min(high, max(at, math.ceil(at * factor) - 1))
        out.append((at, end))
        at = end + 1
    return out


def shard_query(low: int, high: int, language: str | None = None) -> str:
    return f"stars:{low}..{high}" + (f" language:{language}" if language else "")


def parse_shard(query: str) -> tuple[int, int, str | None]:
    """The range and language of a shard's query; else ``ValueError``."""
    match = re.fullmatch(r"stars:(\d+)\.\.(\d+)(?: language:(\S+))?", query.strip())
    if not match or int(match[1]) > int(match[2]):
        raise ValueError(f"no shard: {query!r}")
    return int(match[1]), int(match[2]), match[3]


def language_queries(languages: list[str], low: int, high: int) -> list[str]:
    return [shard_query(low, high, x) for x in dict.fromkeys(languages)]


def plan_for_target(target: int, expected: list[tuple[tuple[int, int], int]], most: int = 1000) -> list[tuple[int, int]]:
    """Shards from the top until ``target`` rows are expected; no shard gives more than ``most``."""
    out, total = [], 0
    for shard, rows in sorted(expected, key=lambda x: -x[0][0]):
        if total >= target:
            break
        out.append(shard)
        total += min(rows, most)
    return out


def estimate(calls: int, seconds_per_call: float, workers: int, per_minute: int) -> float:
    """Seconds that calls take: bounded by the workers or by the rate, whichever is slower."""
    return max(calls * seconds_per_call / max(1, workers), 60.0 * calls / max(1, per_minute))


def shard_statistics(shards: DataFrame) -> DataFrame:
    """Rows per shard at least, at most and on average; empty and stalled (begun, not ended, no rows) shards."""
    return shards.agg(
        F.count(F.lit(1)).alias("shards"), F.min("rows").alias("min"), F.max("rows").alias("max"), F.round(F.avg("rows"), 3).alias("mean"),
        F.count_if(F.col("done") & (F.col("rows") == 0)).alias("empty"), F.count_if(~F.col("done") & (F.col("rows") == 0)).alias("stalled"),
    )


def doctor(shards: DataFrame, target: int) -> str:
    """``COMPLETE``, ``INTERRUPTED``, ``PLAN EXHAUSTED`` or ``IN PROGRESS``, from how far the shards came."""
    one = shards.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(~F.col("done")).alias("open"), F.count_if(F.col("cursor").isNotNull() & ~F.col("done")).alias("begun")).first()
    if one["rows"] >= target:
        return "COMPLETE"
    if one["begun"]:
        return "INTERRUPTED"
    return "IN PROGRESS" if one["open"] else "PLAN EXHAUSTED"


def next_step(counts: dict[str, int]) -> str:
    """What to run next, from how many rows each stage has made."""
    total = max(1, counts.get("repo", 0))
    for stage, least in (("repo", 1), ("clean", 0.9 * total), ("embedded", 0.9 * counts.get("clean", 0)), ("placed", 1), ("clustered", 1), ("edges", 1), ("ranked", 1), ("scored", 1)):
        if counts.get(stage, 0) < max(1, least):
            return {"repo": "ingest", "clean": "clean", "embedded": "embed", "placed": "project", "clustered": "cluster", "edges": "edges", "ranked": "rank", "scored": "calibrate"}[stage]
    return "build"


def assess_coverage(occupied: float, max_share: float, gini: float, points: int) -> list[str]:
    """What is wrong with a map's spread; maps under 100 points aren't judged."""
    if points < 100:
        return []
    checks = ((occupied < 0.5, "under half the cells are in use"), (max_share > 0.10, "one cell holds over a tenth"), (gini > 0.85, "very uneven"))
    return [text for bad, text in checks if bad]


def graph_shape_warning(components: int, communities: int) -> bool:
    """Whether the communities mostly mirror a graph in pieces."""
    return components > 0.5 * max(1, communities)

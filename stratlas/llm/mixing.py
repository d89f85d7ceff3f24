"""Mixing of sources to target weights (problem 9).

Token streams are packed into fixed-length blocks inside each scan task; blocks of a source are numbered by
a prefix sum over (source, task) counts, so nothing is sorted and no source is gathered anywhere. Each output
shard draws its source counts from a multinomial; its slots are mapped to block numbers through a keyed
pseudorandom permutation of the source's blocks, one per repeat, and joined with the blocks by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stratlas.llm.bpe import vocabulary_path
from stratlas.llm.encode import encoder
from stratlas.session import materialise

BLOCKS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


MOST_STARTS = 500_000  # rows of three short values


def source_key(column):
    """Sources count regardless of case and outer blanks."""
    return F.lower(F.trim(column))


def token_blocks(docs: DataFrame, sources: list[str], block_len: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Blocks of ``block_len`` ids of each wanted source; a task's last block of a source may be shorter.

    Documents of other or null sources, and null or empty texts, hold no tokens of the mix. A document never
    loses tokens: long ones run over several blocks, short ones share one. The blocks are written once to the
    shared folder, for their numbers must not change when an executor is lost.
    """
    wanted = docs.select(source_key(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    wanted = wanted.where(F.col("source").isin(sources) & (F.col("text") != "")).withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, open_, seq, task = encoder(vocabulary or vocabulary_path()), {}, {}, 0

        def out(rows: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            numbers = []
            for source, _ in rows:
                numbers.append(seq.get(source, 0))
                seq[source] = numbers[-1] + 1
            ends = np.r_[0, np.cumsum([len(x) for _, x in rows])]
            flat = np.concatenate([x for _, x in rows])
            field = pa.field("element", pa.int32(), False)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in rows], pa.string()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(numbers, pa.int64()),
                    pa.array([len(x) for _, x in rows], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), type=pa.list_(field)),
                ],
                names=BLOCKS.names,
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                task = part.column(2)[0].as_py()
                names = part.column(0).to_pylist()
                flat, ends = bpe.encode(part.column(1).to_pylist())
                full = []
                for k, source in enumerate(names):
                    open_.setdefault(source, []).append(flat[ends[k] : ends[k + 1]])
                for source in sorted(set(names)):
                    stream = np.concatenate(open_[source])
                    n = len(stream) // block_len
                    full += [(source, stream[i * block_len : (i + 1) * block_len]) for i in range(n)]
                    open_[source] = [stream[n * block_len :]]
                if full:
                    yield out(full)
        rest = [(s, np.concatenate(x)) for s, x in sorted(open_.items())]
        rest = [(s, x) for s, x in rest if len(x)]
        if rest:
            yield out(rest)

    return materialise(wanted.mapInArrow(run, BLOCKS), "mix-blocks")


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ``block_no``, 0, 1, … within their source.

    The prefix sum runs over one row per (source, task): at most the mix's sources times the scan's tasks. While these are
    at most ``MOST_STARTS`` they travel to the blocks, which are then not shuffled for their numbers; more are joined by key.
    """
    counts = blocks.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("source", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = materialise(starts, "mix-starts")
    if starts.count() <= MOST_STARTS:
        starts = F.broadcast(starts)
    return blocks.join(starts, ["source", "task"]).withColumn("block_no", F.col("start") + F.col("seq")).drop("start")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0…size-1, element-wise: a four-round Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = index.astype(np.uint64)
    limit = size.astype(np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = value[todo] >> h, value[todo] & m
        for r in range(4):
            x = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(32)) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= limit[todo]]
    return value.astype(np.int64)


def mix_plan(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: tokens and blocks held, tokens wanted, slots granted, and whether it falls short.

    ``short`` means that all its documents, each used ``max_repeats`` times, hold fewer tokens than
    ``target_weight × budget_tokens``; such a source gets all its blocks ``max_repeats`` times and the others
    keep their own targets. Null ``max_repeats`` counts as 1, a null weight as 0; a source without
    documents is short unless its target is 0; targets named twice (after folding case and blanks) are added up.
    """
    held = blocks.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"), F.count(F.lit(1)).alias("held_blocks"))
    goal = targets.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"),
        F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
        F.max("budget_tokens").alias("budget_tokens"),
    )
    plan = goal.join(held, "source", "left").na.fill(0, ["held_tokens", "held_blocks"])
    wanted = F.col("target_weight") * F.col("budget_tokens")
    mean = F.col("held_tokens") / F.greatest("held_blocks", F.lit(1))
    slots = F.when(F.col("held_blocks") == 0, 0).otherwise(
        F.least(F.ceil(wanted / mean), F.col("held_blocks") * F.col("max_repeats"))
    )
    return plan.select(
        "*",
        wanted.alias("wanted_tokens"),
        (F.col("held_tokens") * F.col("max_repeats")).alias("capacity_tokens"),
        (F.col("held_tokens") * F.col("max_repeats") < wanted).alias("short"),
        slots.cast("long").alias("slots"),
    )


def shard_draws(plan: list, shard_blocks: int, seed: int, most_shards: int = 4096) -> pd.DataFrame:
    """Source counts of each output shard, drawn from a multinomial of the slots still open.

    One row per (shard, source) with a count; the driver holds at most ``most_shards`` times the sources, for
    shards grow beyond ``shard_blocks`` where there would be more of them.
    """
    rng = np.random.default_rng(seed)
    left = np.array([r["slots"] for r in plan], np.int64)
    given = np.zeros_like(left)
    total = int(left.sum())
    size = max(shard_blocks, math.ceil(total / most_shards))
    rows, shard = [], 0
    while left.sum():
        draw = np.zeros_like(left)
        room = min(size, int(left.sum()))
        while room:
            more = np.minimum(rng.multinomial(room, left_share(left - draw)), left - draw)
            draw += more
            room -= int(more.sum())
        for k in np.flatnonzero(draw):
            rows.append((shard, plan[k]["source"], int(given[k]), int(draw[k]), int(plan[k]["held_blocks"])))
        given += draw
        left -= draw
        shard += 1
    return pd.DataFrame(rows, columns=["shard", "source", "first_slot", "n_slots", "held_blocks"]).astype(
        {"shard": "int64", "first_slot": "int64", "n_slots": "int64", "held_blocks": "int64"}
    )


def left_share(left: np.ndarray) -> np.ndarray:
    return left / left.sum()


def mix_slots(plan: DataFrame, shard_blocks: int = 64, seed: int = 7) -> DataFrame:
    """``(shard, slot, source, repeat, block_no)``: which block stands in each slot of the mix.

    Slot k of a source lies in repeat ``k div blocks`` and takes the block that this repeat's permutation puts
    there, so no block, and with it no document, is used more often than the plan allows.
    """
    spark = plan.sparkSession
    drawn = shard_draws(plan.orderBy("source").collect(), shard_blocks, seed)  # the plan has one row per target source
    schema = "shard long, source string, first_slot long, n_slots long, held_blocks long"
    draws = spark.createDataFrame(list(drawn.itertuples(index=False, name=None)), schema)
    slots = draws.select(
        "shard", "source", "held_blocks", F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("n_slots") - 1)).alias("slot")
    )
    slots = slots.withColumn("repeat", F.expr("slot div held_blocks")).withColumn(
        "key", F.xxhash64("source", "repeat", F.lit(seed))
    )

    @F.pandas_udf("long")
    def place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()), dtype="int64")

    return slots.select("shard", "slot", "source", "repeat", place(F.expr("slot % held_blocks"), "held_blocks", "key").alias("block_no"))


def planned(docs: DataFrame, targets: DataFrame, block_len: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The blocks of the wanted sources and the plan over them.

    Sources of ``targets`` are few (a control table): their names are collected to prune the scan.
    """
    names = [r[0] for r in targets.select(source_key(F.col("source"))).distinct().collect() if r[0] is not None]
    blocks = token_blocks(docs, names, block_len)
    return blocks, materialise(mix_plan(blocks, targets), "mix-plan")


def mix(docs: DataFrame, targets: DataFrame, block_len: int = 4096, shard_blocks: int = 64, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The plan and the mix itself: one row per slot with its block's ids."""
    blocks, plan = planned(docs, targets, block_len)
    return plan, mix_slots(plan, shard_blocks, seed).join(numbered(blocks), ["source", "block_no"])


def mix_report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source: its target, the tokens and share reached, the most uses of any block, and ``short``."""
    uses = mixed.groupBy("source", "block_no").agg(F.count(F.lit(1)).alias("uses"), F.max("n_tokens").alias("n_tokens"))
    got = uses.groupBy("source").agg(
        F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens"), F.max("uses").cast("int").alias("most_uses")
    )
    rows = plan.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_uses"])
    rows = rows.withColumn("all_tokens", F.sum("mixed_tokens").over(W.partitionBy(F.lit(0))))  # a row per target source
    return rows.select(
        "source", "target_weight", "max_repeats", "wanted_tokens", "held_tokens", "capacity_tokens", "mixed_tokens",
        (F.col("mixed_tokens") / F.col("all_tokens")).alias("actual_share"), "most_uses", "short",
    )

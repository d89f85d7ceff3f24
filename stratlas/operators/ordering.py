"""Global order without a single-task sort: rows are ranged over tasks, sorted there and numbered by prefix sums.

The number of tasks is the session's ``spark.sql.shuffle.partitions``, so a task's share follows that setting at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.session import materialise


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted over all tasks, with its ``__task`` and its ``__row`` there (from 0); written, for ranges are drawn by sample."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    rows = materialise(rows, "ordered")
    return rows.select(*df.columns, F.shiftright("__m", 33).alias("__task"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"))


def global_positions(df: DataFrame, key: str, *tiebreak: Column, out: str = "position") -> DataFrame:
    """1, 2, … in descending order of the numeric ``key`` (nulls last), then by ``tiebreak``.

    Rows that agree in all of these are numbered in any order, and lie in one task.
    """
    rows = in_order(df, F.col(key).desc_nulls_last(), *tiebreak)
    sizes = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__task", F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = rows.join(F.broadcast(starts), "__task")  # a row per task
    return numbered.withColumn(out, (F.col("__start") + F.col("__row") + 1).cast("long")).select(*[c for c in df.columns if c != out], out)


def prefix_sums(counts: DataFrame, group: str, value: str, n: str = "n") -> DataFrame:
    """``counts`` with ``before``, the sum of ``n`` over smaller values of the group, and ``all``, the group's total.

    ``counts`` has each value of each of a few groups once, and no null value.
    """
    rows = in_order(counts, F.col(group), F.col(value))
    inside = W.partitionBy("__task", group).orderBy("__row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    sizes = rows.groupBy(group, "__task").agg(F.sum(n).alias("__n"))  # at most tasks + groups rows
    earlier = F.sum("__n").over(W.partitionBy(group).orderBy("__task").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("__g"), F.col("__task").alias("__t"), F.coalesce(earlier, F.lit(0)).alias("__start"), F.sum("__n").over(W.partitionBy(group)).alias("all"))
    done = rows.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__task") == F.col("__t")))
    return done.select(*counts.columns, (F.col("__start") + F.col("__inside")).alias("before"), "all")


def quantiles(df: DataFrame, value: str, shares: list[float], group: Column | None = None, discrete: bool = False) -> DataFrame:
    """``(g, q)``: exact quantiles of ``value`` per group (few groups), interpolated or, if ``discrete``, values that occur.

    Distinct values with counts are ranked by prefix sums, so no task ever holds a group's values. Null and NaN
    values don't count; a group without values has no row.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select((group if group is not None else F.lit("")).cast("string").alias("g"), v.alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, "g", "v").select("g", "v", "all", F.col("before").alias("lo"), (F.col("before") + F.col("n") - 1).alias("hi"))
    wanted = []
    for i, p in enumerate(shares):
        at = F.greatest(F.ceil(F.lit(p) * F.col("all")) - 1, F.lit(0)) if discrete else F.lit(p) * (F.col("all") - 1)
        low, high = F.floor(at), F.ceil(at)
        wanted += [F.struct(F.lit(i).alias("i"), low.cast("long").alias("k"), (1 - (at - low)).cast("double").alias("w")), F.struct(F.lit(i).alias("i"), high.cast("long").alias("k"), (at - low).cast("double").alias("w"))]
    hits = ranked.select("g", "v", "lo", "hi", F.explode(F.array(*wanted)).alias("t")).where("t.k between lo and hi")
    each = hits.groupBy("g", F.col("t.i").alias("i")).agg(F.sum(F.col("v") * F.col("t.w")).alias("q"))
    return each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))

"""A seeded synthetic catalogue for tests and demonstrations, of any size: every row follows from its number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(seed: int, *columns: str | Column) -> Column:
    """A number in 0…1 that follows from the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(2**53))


def world(spark: SparkSession, n: int, poles: int = 12, spread: float = 0.25, seed: int = 0) -> DataFrame:
    """``(repo_id, full_name, theta, phi, domain, stars, low_signal, is_archived, is_fork)`` scattered around ``poles`` poles."""
    golden = math.pi * (3 - math.sqrt(5))
    rows = spark.range(n).withColumnRenamed("id", "repo_id")
    rows = rows.withColumn("domain", F.floor(F.pow(unit(seed, "repo_id"), F.lit(1.5)) * poles).cast("int"))
    height = 1 - 2 * (F.col("domain") + 0.5) / poles
    # a pole on a spiral, and a Gaussian step away from it (Box-Muller)
    step = spread * F.sqrt(-2 * F.log(F.greatest(unit(seed + 1, "repo_id"), F.lit(1e-12))))
    turn = 2 * math.pi * unit(seed + 2, "repo_id")
    theta = F.acos(height) + step * F.cos(turn)
    phi = F.col("domain") * golden + step * F.sin(turn)
    from stratlas.operators.sphere import wrapped

    t, p = wrapped(theta, phi)
    stars = F.least(F.lit(400_000), F.floor(8 * F.pow(1 - unit(seed + 3, "repo_id"), F.lit(-1 / 1.1)))).cast("int")
    name = F.concat(F.lit("owner"), (F.col("repo_id") % 997).cast("string"), F.lit("/project"), F.col("repo_id").cast("string"))
    flag = lambda k, share: unit(seed + k, "repo_id") < share
    return rows.select("repo_id", name.alias("full_name"), t.alias("theta"), p.alias("phi"), "domain", stars.alias("stars"), flag(4, 0.05).alias("low_signal"), flag(5, 0.08).alias("is_archived"), flag(6, 0.03).alias("is_fork"))


def edges(spark: SparkSession, n: int, each: int = 3, inside: float = 0.8, domains: int = 12, seed: int = 0) -> DataFrame:
    """``(src, dst, kind, weight)``: every record points at ``each`` earlier ones, early ones far more often, ``inside`` of them of its own domain.

    The preference for early records stands in for growth by attachment, which would have to run one record after the other.
    """
    rows = spark.range(1, n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    early = F.floor(F.pow(unit(seed + 7, "src", "k"), F.lit(2.5)) * F.col("src"))
    own = F.floor(early / domains) * domains + F.col("src") % domains
    target = F.when((unit(seed + 8, "src", "k") < inside) & (own < F.col("src")), own).otherwise(early)
    return rows.select("src", target.cast("long").alias("dst"), F.lit(0).alias("kind"), unit(seed + 9, "src", "k").alias("weight")).where("src <> dst").dropDuplicates(["src", "dst"])

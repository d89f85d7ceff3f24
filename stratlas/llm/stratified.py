"""Samples that match target category proportions (problem 7).

Category margins are raked by iterative proportional fitting over the small table of cells, the raked weights give the
expected counts and each record's exponential key, small categories are repaired up to their minimum, and what could not be
met is reported.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from stratlas.functions.bands import ACTIVITY_BANDS, STAR_BANDS, band_of, days_before

NOW = "2026-01-01 00:00:00"
OCTAVE = 128  # buckets of keys for each doubling


def strata(repo: DataFrame, world: DataFrame, now: str = NOW) -> DataFrame:
    """``(id, stratum_key, s, d, a)`` of repositories with a domain; others belong to no stratum.

    Null stars count as 0, a null ``pushed_at`` as the oldest activity band. Repeated rows of an id count once
    (its largest stars, latest push, smallest domain); a null id is no repository.
    """
    one = repo.where("id is not null").groupBy("id").agg(F.max("stars").alias("stars"), F.max("pushed_at").alias("pushed_at"))
    place = world.where("repo_id is not null and domain is not null").groupBy(F.col("repo_id").alias("id")).agg(F.min("domain").alias("d"))
    s = band_of(F.coalesce("stars", F.lit(0)), STAR_BANDS)
    a = band_of(F.coalesce(days_before("pushed_at", now), F.lit(3650.0)), ACTIVITY_BANDS)
    rows = one.join(place, "id").select("id", s.alias("s"), "d", a.alias("a"))
    return rows.withColumn("stratum_key", stratum_key(F.col("s"), F.col("d"), F.col("a")))


def stratum_key(s: Column, d: Column, a: Column) -> Column:
    return F.concat(F.lit("s"), s.cast("string"), F.lit("_d"), F.lpad(d.cast("string"), 2, "0"), F.lit("_a"), a.cast("string"))


def wanted_of(share: Column, minimum: Column, size: Column) -> Column:
    """The larger of the minimum and share × size rounded half up."""
    return F.greatest(F.coalesce(minimum, F.lit(0)).cast("long"), F.floor(share * size + 0.5).cast("long"))


def rake(cells: dict[tuple, float], margins: list[dict], rounds: int = 200, tolerance: float = 1e-10) -> dict[tuple, float]:
    """Iterative proportional fitting: weights of cells so that each category margin sums to its target.

    ``cells`` maps a tuple of categories to its count, ``margins[i]`` a category of position i to its target share.
    Categories without records can't be met; their share is spread over the others of the margin.
    """
    keys = sorted(cells)
    mass = np.array([float(cells[k]) for k in keys])
    codes, goals = [], []
    for i, margin in enumerate(margins):
        names = sorted({k[i] for k in keys})
        codes.append(np.array([names.index(k[i]) for k in keys], np.int64))
        goal = np.array([margin.get(n, 0.0) for n in names])
        goals.append(goal / goal.sum() if goal.sum() else goal)
    fitted = mass / mass.sum() if len(mass) else mass
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weights=fitted, minlength=len(goal))
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            fitted = fitted * factor[code]
            worst = max(worst, float(np.abs(now - goal).max(initial=0)))
        if worst < tolerance:
            break
    return {k: float(f / m) for k, f, m in zip(keys, fitted, mass) if m}


def raked_counts(cells: dict[tuple, float], margins: list[dict], size: float) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """``(expected counts, weights)`` of cells in a sample of ``size``: no cell gives more records than it has.

    Cells that the raked weights would overdraw are taken whole, and the others are raked again to what the
    margins still lack.
    """
    counts: dict[tuple, float] = {}
    weights: dict[tuple, float] = {}
    free = {k: n for k, n in cells.items() if n > 0}
    left = [{name: share * size for name, share in margin.items()} for margin in margins]
    while free:
        place = max(0.0, size - sum(counts.values()))
        fitted = rake(free, left)
        over = {k for k, n in free.items() if fitted[k] * place > 1}
        for k in over or free:
            counts[k] = float(free[k]) if over else fitted[k] * place * free[k]
            weights[k] = fitted[k]
        for k in over:
            for i, margin in enumerate(left):
                if k[i] in margin:
                    margin[k[i]] = max(0.0, margin[k[i]] - free[k])
        free = {k: n for k, n in free.items() if k not in over} if over else {}
    return counts, weights


def whole_counts(exact: dict[str, float], size: int) -> dict[str, int]:
    """Counts rounded to whole ones that add up to ``size`` as nearly as rounding down and up allows (largest remainders; ties by name)."""
    given = {k: int(v + 1e-9) for k, v in exact.items()}
    rest = max(0, min(size, int(sum(exact.values()) + 0.5)) - sum(given.values()))
    for k in sorted(exact, key=lambda k: (given[k] - exact[k], k))[:rest]:
        given[k] += 1
    return given


def repair(given: dict[str, int], least: dict[str, int], have: dict[str, int], size: int) -> dict[str, int]:
    """Raise every stratum to ``least``, at the cost of those above theirs; hand out places still free where records are left.

    The sample is larger than ``size`` only where the least counts alone are.
    """
    out = {k: min(have.get(k, 0), max(n, least[k])) for k, n in given.items()}
    over = {k: n - least[k] for k, n in out.items() if n > least[k]}
    cut = min(sum(out.values()) - size, sum(over.values()))
    if cut > 0:
        for k, n in whole_counts({k: cut * n / sum(over.values()) for k, n in over.items()}, cut).items():
            out[k] -= n
    while (left := size - sum(out.values())) > 0 and (spare := {k: have.get(k, 0) - n for k, n in out.items() if have.get(k, 0) > n}):
        share = {k: min(n, left * n / sum(spare.values())) for k, n in spare.items()}
        for k, n in whole_counts(share, left).items():
            out[k] += min(n, spare[k])
        if not any(whole_counts(share, left).values()):
            break
    return out


def plan_sample(rows: DataFrame, targets: DataFrame, extra: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The allocation of every targeted stratum, and the raked weight of every cell.

    ``(stratum_key, target_share, wanted, available, raked, allocation, gap)`` and ``(stratum_key, *extra, weight)``. The margins
    are the strata themselves, the categories that their keys name (stars, domain, activity), and those of ``extra``,
    which may cut across strata: a column of ``rows`` with target shares of its values. Raked weights give each cell's
    expected count; strata are then repaired to what is wanted, the larger of ``min_count`` and the rounded share, as
    far as records are there. So the places that a short stratum leaves go where the margins it belongs to lack records.
    ``gap`` is what is missing. A null in an ``extra`` column is a category without a target.
    The tables have a row per target, times the values of ``extra`` (control tables), so they are worked out on the driver.
    """
    extra = extra or {}
    spark = rows.sparkSession
    names = ["stratum_key", *extra]
    keys = F.broadcast(targets.select("stratum_key").distinct())
    cells = {tuple(r)[:-1]: r["count"] for r in rows.join(keys, "stratum_key").groupBy(*names).count().collect()}
    have: dict[str, int] = {}
    for cell, n in cells.items():
        have[cell[0]] = have.get(cell[0], 0) + n
    goal = targets.where("stratum_key is not null").groupBy("stratum_key").agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max("min_count").alias("least"), F.max("sample_size").alias("size")
    )
    goal = goal.select("*", wanted_of(F.col("share"), F.col("least"), F.col("size")).alias("wanted")).orderBy("stratum_key").collect()
    parts = {r["stratum_key"]: tuple(r["stratum_key"].split("_")) for r in goal}
    width = max((len(p) for p in parts.values()), default=0)
    parts = {k: (*p, *[""] * (width - len(p))) for k, p in parts.items()}
    margins: list[dict] = [{r["stratum_key"]: r["share"] for r in goal}, *({} for _ in range(width)), *extra.values()]
    for r in goal:
        for i, name in enumerate(parts[r["stratum_key"]]):
            margins[i + 1][name] = margins[i + 1].get(name, 0.0) + r["share"]
    size = max((r["size"] or 0 for r in goal), default=0)
    counts, weights = raked_counts({(c[0], *parts[c[0]], *map(str, c[1:])): n for c, n in cells.items()}, margins, size)
    raked = {k: 0.0 for k in parts}
    for cell, n in counts.items():
        raked[cell[0]] += n
    least = {r["stratum_key"]: min(have.get(r["stratum_key"], 0), r["wanted"] or 0) for r in goal}
    given = repair(whole_counts(raked, size), least, have, size)
    out = []
    for r in goal:
        k, wanted = r["stratum_key"], r["wanted"] or 0
        out.append((k, r["share"], wanted, have.get(k, 0), raked[k], given[k], max(0, wanted - have.get(k, 0))))
    table = spark.createDataFrame(out, "stratum_key string, target_share double, wanted long, available long, raked double, allocation long, gap long")
    each = [(*c, weights.get((c[0], *parts[c[0]], *map(str, c[1:])), 0.0)) for c in cells]
    schema = T.StructType([T.StructField("stratum_key", T.StringType()), *(rows.schema[c] for c in extra), T.StructField("weight", T.DoubleType())])
    return table, spark.createDataFrame(each, schema)


def draw(rows: DataFrame, table: DataFrame, weights: DataFrame, seed: int = 11) -> DataFrame:
    """``(id, stratum_key, weight)`` of the sample: each stratum's ``allocation`` records of the smallest keys.

    A record's key is -ln(u)/weight with u from a hash of its id and the seed, so draws are the same on
    every run; the weight is its cell's raked one. A stratum may hold a third of all rows: its keys are counted in buckets on
    a scale of powers, all rows of the buckets below the one in which the allocation is reached are taken as they
    are, and only that bucket is sorted.
    """
    by = [c for c in weights.columns if c != "weight"]
    few = table.where("allocation > 0").select("stratum_key", "allocation")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by])
    unit = (F.shiftrightunsigned(F.xxhash64("r.id", F.lit(seed)), 11) + 1) / F.lit(float(2**53 + 1))
    keyed = rows.alias("r").join(F.broadcast(weights.alias("w")), same).select("r.id", "r.stratum_key", "w.weight", unit.alias("u"))  # a row per cell
    keyed = keyed.join(F.broadcast(few), "stratum_key")  # a row per target
    keyed = keyed.withColumn("key", -F.log("u") / F.greatest("weight", F.lit(1e-300))).withColumn("bucket", F.floor(F.log2("key") * OCTAVE))
    counts = keyed.groupBy("stratum_key", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("allocation").alias("allocation"))
    running = F.sum("n").over(W.partitionBy("stratum_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    cut = counts.withColumn("before", F.coalesce(running, F.lit(0))).where(F.col("before") < F.col("allocation"))
    cut = cut.groupBy("stratum_key").agg(F.max("bucket").alias("last"), F.max("before").alias("before"))  # the last one reached
    low = keyed.join(F.broadcast(cut), "stratum_key").where(F.col("bucket") <= F.col("last"))
    order = W.partitionBy("stratum_key").orderBy("key", "id")
    edge = low.where(F.col("bucket") == F.col("last")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("allocation") - F.col("before"))
    columns = ["id", "stratum_key", "weight"]
    return low.where(F.col("bucket") < F.col("last")).select(columns).unionByName(edge.select(columns))


def sample_report(table: DataFrame, sample: DataFrame) -> DataFrame:
    """Per targeted stratum what was wanted, there, allocated, drawn, and the residual gap."""
    drawn = sample.groupBy("stratum_key").agg(F.count(F.lit(1)).alias("drawn"))
    rows = table.join(drawn, "stratum_key", "left").na.fill(0, ["drawn"])
    total = F.sum("drawn").over(W.partitionBy(F.lit(0)))  # a row per target
    share = F.col("drawn") / F.greatest(total, F.lit(1))
    return rows.select("stratum_key", "target_share", "wanted", "available", "allocation", "drawn", share.alias("share"), "gap")

"""Positions on the sphere: conversions, distances, means, quantised angles, cluster manifests. The pole is y."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = 2 * math.pi


def xyz(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return F.sin(theta) * F.cos(phi), F.cos(theta), F.sin(theta) * F.sin(phi)


def angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Polar angle and azimuth within one turn."""
    size = F.sqrt(x * x + y * y + z * z)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), y / size))), F.pmod(F.atan2(z, x), F.lit(TURN))


def wrapped(theta: Column, phi: Column) -> tuple[Column, Column]:
    """Angles brought into 0…π and one turn by going over the pole, never by clamping."""
    t = F.pmod(theta, F.lit(TURN))
    over = t > math.pi
    return F.when(over, TURN - t).otherwise(t), F.pmod(F.when(over, phi + math.pi).otherwise(phi), F.lit(TURN))


def great_circle(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The angle between two unit vectors: atan2 of the cross product's length and the dot product."""
    cx, cy, cz = a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
    return F.atan2(F.sqrt(cx * cx + cy * cy + cz * cz), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def placed(world: DataFrame) -> DataFrame:
    """Rows with a position, with x, y and z."""
    rows = world.where("theta is not null and phi is not null")
    x, y, z = xyz(F.col("theta"), F.col("phi"))
    return rows.withColumns({"x": x, "y": y, "z": z})


def spherical_means(rows: DataFrame, key: str, id_col: str = "repo_id") -> DataFrame:
    """``(key, n, mx, my, mz, r)``: unit mean and resultant length; where positions cancel out, the first member's position."""
    means = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a{c}") for c in "xyz"], F.min_by(F.struct("x", "y", "z"), id_col).alias("first"))
    r = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    means = means.withColumn("r", r)
    return means.select(key, "n", *[F.when(F.col("r") < 1e-9, F.col("first")[c]).otherwise(F.col(f"a{c}") / F.col("r")).alias(f"m{c}") for c in "xyz"], "r")


def concentration(r: Column) -> Column:
    """κ of a distribution with resultant length r, 1e4 from 0.9999 on."""
    return F.when(r >= 0.9999, F.lit(1e4)).otherwise(r * (3 - r * r) / (1 - r * r))


def manifest(world: DataFrame, most: int = 400) -> DataFrame:
    """``(cluster_id, size, theta, phi, kappa, domain)`` of the ``most`` largest clusters; noise (-1) is none."""
    from stratlas.operators.aggregates import modal

    rows = placed(world.where("cluster_id >= 0"))
    means = spherical_means(rows, "cluster_id")
    theta, phi = angles(F.col("mx"), F.col("my"), F.col("mz"))
    shown = means.select("cluster_id", F.col("n").alias("size"), theta.alias("theta"), phi.alias("phi"), concentration(F.col("r")).alias("kappa"))
    shown = shown.join(modal(rows, "cluster_id", "domain"), "cluster_id", "left").na.fill(0, ["domain"])
    return shown.orderBy(F.desc("size"), "cluster_id").limit(most)


def quantised(theta: Column, phi: Column, size: Column) -> tuple[Column, Column, Column]:
    """16-bit polar angle, azimuth and size; halves go to the even number."""
    return (
        F.rint(theta * 32767 / math.pi).cast("int"),
        F.least(F.lit(65535), F.rint(F.pmod(phi, F.lit(TURN)) * 65535 / TURN).cast("int")),
        F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), size)) * 65535).cast("int"),
    )


def viewport(rows: DataFrame, radius: float = 1.0) -> DataFrame:
    """Where to look to see all rows: centre, largest angle from it (at least 0.04), and altitude."""
    one = rows.withColumn("__k", F.lit(1))
    means = spherical_means(one, "__k").select("__k", "mx", "my", "mz")
    away = great_circle((F.col("x"), F.col("y"), F.col("z")), (F.col("mx"), F.col("my"), F.col("mz")))
    spread = one.join(F.broadcast(means), "__k").groupBy("mx", "my", "mz").agg(F.greatest(F.lit(0.04), F.max(away)).alias("spread"))
    theta, phi = angles(F.col("mx"), F.col("my"), F.col("mz"))
    return spread.select(theta.alias("theta"), phi.alias("phi"), "spread", (radius * (1.18 + 1.7 * F.col("spread"))).alias("altitude"))


def expectations(world: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(check, mean_distance, limit, near, ok)``: named pairs should lie nearer or farther apart than a limit.

    ``pairs`` is a control table (check, a, b, limit, near); checks without any placed pair don't come out.
    """
    rows = placed(world).select("full_name", "x", "y", "z")
    a = rows.select(F.col("full_name").alias("a"), F.struct("x", "y", "z").alias("pa"))
    b = rows.select(F.col("full_name").alias("b"), F.struct("x", "y", "z").alias("pb"))
    both = pairs.join(a, "a").join(b, "b")
    away = great_circle(*[tuple(F.col(f"{p}.{c}") for c in "xyz") for p in ("pa", "pb")])
    per = both.groupBy("check").agg(F.avg(away).alias("mean_distance"), F.max("limit").alias("limit"), F.max("near").alias("near"))
    return per.withColumn("ok", F.when(F.col("near"), F.col("mean_distance") <= F.col("limit")).otherwise(F.col("mean_distance") >= F.col("limit")))


def project(vectors: DataFrame, id_col: str, v: str, width: int) -> DataFrame:
    """``(id, theta, phi)``: a deterministic projection — whitened, onto the three leading directions, to unit length.

    It stands in for manifold projections, which need a library that isn't here; distances are coarser.
    """
    import numpy as np

    from stratlas.operators.vectors import moments

    n, total, gram = moments(vectors, v, width)
    mean = total / max(n, 1)
    values, axes = np.linalg.eigh(gram / max(n, 1) - np.outer(mean, mean))
    axes = axes[:, np.argsort(values)[::-1][:3]].T
    axes = axes * np.where(axes[np.arange(3), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    lead = [F.aggregate(F.zip_with(F.col(v), F.array(*[F.lit(float(w)) for w in axis]), lambda x, w: x.cast("double") * w), F.lit(-float(mean @ axis)), lambda s, x: s + x) for axis in axes]
    rows = vectors.where(F.col(v).isNotNull()).select(F.col(id_col).alias("id"), *[c.alias(n) for c, n in zip(lead, "xyz")])
    theta, phi = angles(F.col("x"), F.col("y"), F.col("z"))
    return rows.select("id", theta.alias("theta"), phi.alias("phi"))


def regions(world: DataFrame, k: int, domains: int = 12, rounds: int = 100) -> DataFrame:
    """``(repo_id, region, domain)``: spherical k-means regions, then the regions' centres grouped into domains by size.

    The second grouping has one row a region.
    """
    from stratlas.operators.vectors import spherical_kmeans

    rows = placed(world).select(F.col("repo_id").alias("id"), F.array("x", "y", "z").alias("v"))
    labels, centres = spherical_kmeans(rows, "id", "v", k, 3, rounds)
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [(i, [float(x) for x in c], float(sizes.get(i, 0))) for i, c in enumerate(centres) if sizes.get(i)]
    if not small:
        return labels.select(F.col("id").alias("repo_id"), F.col("label").alias("region"), F.lit(0).alias("domain"))
    table = world.sparkSession.createDataFrame(small, "id long, v array<double>, w double").coalesce(1)
    groups, _ = spherical_kmeans(table, "id", "v", min(domains, len(small)), 3, rounds, "w")
    named = groups.select(F.col("id").cast("int").alias("region"), F.col("label").alias("domain"))
    return labels.select(F.col("id").alias("repo_id"), F.col("label").alias("region")).join(F.broadcast(named), "region")


def community_domains(world: DataFrame, labels: DataFrame, domains: int = 12, rounds: int = 100) -> DataFrame:
    """``(label, domain)``: communities grouped by place, their size-weighted mean positions by spherical k-means.

    ``labels`` are ``(id, label)``; communities without a placed member have no domain. There is a row for each community.
    """
    from stratlas.operators.vectors import spherical_kmeans

    rows = placed(world).join(labels.select(F.col("id").alias("repo_id"), "label"), "repo_id")
    means = spherical_means(rows, "label").select(F.col("label").alias("id"), F.array("mx", "my", "mz").alias("v"), F.col("n").cast("double").alias("w"))
    groups, _ = spherical_kmeans(means, "id", "v", max(1, min(domains, means.count())), 3, rounds, "w")
    return groups.select(F.col("id").alias("label"), F.col("label").alias("domain"))


def baseline_distance(world: DataFrame, seed: int = 5) -> DataFrame:
    """Mean angle between each record and a pseudorandom other: what a map without structure would give for any pair."""
    from stratlas.operators.ordering import global_positions

    rows = placed(world).select(F.col("repo_id").alias("id"), "x", "y", "z").withColumn("h", F.lit(0))
    numbered = global_positions(rows, "h", F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}"))), F.col("id"), out="i")
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    a = numbered.join(F.broadcast(n), F.lit(True)).select(F.struct("x", "y", "z").alias("a"), (F.col("i") % F.col("n") + 1).alias("j"))
    b = numbered.select(F.struct("x", "y", "z").alias("b"), F.col("i").alias("j"))
    away = great_circle(*[tuple(F.col(f"{s}.{c}") for c in "xyz") for s in "ab"])
    return a.join(b, "j").agg(F.round(F.avg(away), 6).alias("mean_distance"), F.count(F.lit(1)).alias("pairs"))

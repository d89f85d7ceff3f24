"""Density clusters on the sphere, by grid cells: a stand-in for hierarchical density clustering, which needs a library that isn't here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.operators import graph as G
from stratlas.operators import sphere as H
from stratlas.session import materialise, release



def density_clusters(world: DataFrame, side: float = 0.02, least_cell: int = 3, least_cluster: int = 20) -> DataFrame:
    """``(repo_id, cluster_id, is_noise)``: neighbouring dense cells hang together; small and sparse ones are noise.

    Only cells are joined, never pairs of records, so a cell of any size costs one row. Noise takes the cluster of
    the nearest mean (-1 where there is none). Clusters are named by the smallest id they hold.
    """
    points = materialise(H.placed(world).select("repo_id", "x", "y", "z", *[F.floor(F.col(c) / side).alias(f"g{c}") for c in "xyz"]), "density-points")
    cell = [f"g{c}" for c in "xyz"]
    cells = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("repo_id").alias("id")).where(F.col("n") >= least_cell)
    cells = materialise(cells, "density-cells")
    step = F.explode(F.array([F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip((a, b, d), "xyz")]) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]))
    around = cells.withColumn("s", step).select(F.col("id").alias("src"), *[(F.col(f"g{c}") + F.col(f"s.d{c}")).alias(f"g{c}") for c in "xyz"])
    links = around.join(cells.withColumnRenamed("id", "dst"), cell).where("src < dst").select("src", "dst")
    groups = cells.join(G.components(cells.select("id"), links), "id")
    sizes = groups.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") >= least_cluster)
    kept = groups.join(sizes.select("component"), "component", "left_semi").select(*cell, F.col("component").alias("cluster_id"))
    rows = materialise(points.join(kept, cell, "left"), "density-rows")
    means = H.spherical_means(rows.where("cluster_id is not null"), "cluster_id").select("cluster_id", "mx", "my", "mz")
    centres = materialise(means.select(F.col("cluster_id").alias("c"), "mx", "my", "mz"), "density-centres")
    noise = rows.where("cluster_id is null").select("repo_id", "x", "y", "z")
    near = nearest_centres(noise, centres, side)
    return rows.join(near, "repo_id", "left").select("repo_id", F.coalesce("cluster_id", "near", F.lit(-1)).alias("cluster_id"), F.col("cluster_id").isNull().alias("is_noise"))


def nearest_centres(points: DataFrame, centres: DataFrame, side: float) -> DataFrame:
    """``(repo_id, near)``: each point's nearest centre, ties to the smaller, by a grid whose cells double in side.

    In each round points meet the centres in the 27 cells around their own; one that lies within a cell's side is the
    nearest of all. The others go on to the next round, the last of which has the whole sphere in its cells.
    """
    spark, found, rest = points.sparkSession, None, materialise(points, "density-rest")
    around = F.explode(F.array([F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip((a, b, d), "xyz")]) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]))
    gap = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0)))
    while side < 4 and rest.limit(1).count():
        cells = centres.withColumn("s", around).select("c", "mx", "my", "mz", *[(F.floor(F.col(f"m{c}") / side) + F.col(f"s.d{c}")).alias(f"g{c}") for c in "xyz"])
        met = rest.select("*", *[F.floor(F.col(c) / side).alias(f"g{c}") for c in "xyz"]).join(cells, ["gx", "gy", "gz"]).withColumn("gap", F.round(gap, 12))
        near = met.where(F.col("gap") <= side).groupBy("repo_id").agg(F.min(F.struct("gap", "c")).alias("m")).select("repo_id", F.col("m.c").alias("near"))
        near = materialise(near, "density-near")
        found = near if found is None else found.unionByName(near)
        rest, before = materialise(rest.join(near, "repo_id", "left_anti"), "density-rest"), rest
        release(before)
        side *= 2
    return found if found is not None else spark.createDataFrame([], "repo_id long, near long")

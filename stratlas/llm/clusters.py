"""Grouping of positions into similarity clusters (problem 2).

Each scan task builds a cluster-feature tree of its positions (count, linear sum, square sum, bounding box: features add
up, so trees merge). Leaf summaries are reduced by region of the sphere and agglomerated there by Ward's criterion, in
rounds whose regions are shifted against each other; one pass over all records assigns each to its nearest centre. No
cluster reaches further than ``EXTENT`` angles from its centre, however heavy a neighbour is, so the exact form (cliques with
nothing similar outside) can be checked in the neighbourhood of each centre without missing one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.session import materialise

BRANCH = 24
EXTENT, SPREAD = 1.2, 0.6  # angles: how far a cluster may reach from its centre, and its root-mean-square radius
LEAF, CELL, FINE = 1 / 3, 1 / 8, 1 / 64  # angles: a leaf's diameter, and the sides of two grids
NAMES = ["n", "lx", "ly", "lz", "ss", "x0", "y0", "z0", "x1", "y1", "z1"]
FEATURE = ", ".join(f"{c} double" for c in NAMES)


def total(features: np.ndarray) -> np.ndarray:
    """The feature of several together: sums of counts and moments, and the box around their boxes."""
    return np.concatenate([features[:, :5].sum(0), features[:, 5:8].min(0), features[:, 8:].max(0)])


def both_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:5] + b[:5], np.minimum(a[5:8], b[5:8]), np.maximum(a[8:], b[8:])])


def single(xyz: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The features of positions with counts."""
    return np.c_[n, xyz * n[:, None], (xyz**2).sum(1) * n, xyz, xyz]


def collapsed(features: np.ndarray, side: float) -> np.ndarray:
    """One feature for each cell of a grid."""
    cells = np.floor(features[:, 1:4] / features[:, :1] / side).astype(np.int64)
    order = np.lexsort(cells.T)
    ranked, cells = features[order], cells[order]
    first = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(1)])
    return np.c_[np.add.reduceat(ranked[:, :5], first), np.minimum.reduceat(ranked[:, 5:8], first), np.maximum.reduceat(ranked[:, 8:], first)]


class FeatureTree:
    """A cluster-feature tree: inner nodes and leaves hold at most ``BRANCH`` features, no leaf's box is wider than ``width``."""

    def __init__(self, width: float):
        self.width = width
        self.root = self._node([], None)

    @staticmethod
    def _node(rows, sub) -> dict:
        f = np.zeros((BRANCH + 1, len(NAMES)))
        if len(rows):
            f[: len(rows)] = rows
        return {"f": f, "k": len(rows), "sub": sub}

    def add(self, feature: np.ndarray) -> None:
        split = self._add(self.root, feature)
        if split:
            self.root = self._node([total(node["f"][: node["k"]]) for node in split], list(split))

    def _add(self, node, feature):
        k = node["k"]
        if k:
            f = node["f"][:k]
            gap = f[:, 1:4] / f[:, :1] - feature[1:4] / feature[0]
            near = int((gap * gap).sum(1).argmin())
            both = both_of(f[near], feature)
            if node["sub"] is None:
                if np.linalg.norm(both[8:] - both[5:8]) <= self.width:
                    node["f"][near] = both
                    return None
            else:
                split = self._add(node["sub"][near], feature)
                if not split:
                    node["f"][near] = both
                    return None
                node["sub"][near] = split[0]
                node["f"][near] = total(split[0]["f"][: split[0]["k"]])
                node["sub"].append(split[1])
                feature = total(split[1]["f"][: split[1]["k"]])
        node["f"][k] = feature
        node["k"] = k + 1
        return self._split(node) if node["k"] > BRANCH else None

    def _split(self, node):
        k = node["k"]
        centres = node["f"][:k, 1:4] / node["f"][:k, :1]
        gaps = ((centres[:, None] - centres[None]) ** 2).sum(2)
        a, b = np.unravel_index(gaps.argmax(), gaps.shape)
        right = gaps[:, b] < gaps[:, a]
        right[b] = a != b
        if a == b:  # all centres coincide
            right[: k // 2] = True
        halves = []
        for mask in (~right, right):
            rows = np.flatnonzero(mask)
            halves.append(self._node(node["f"][rows], [node["sub"][i] for i in rows] if node["sub"] is not None else None))
        return halves

    def leaves(self) -> np.ndarray:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node["sub"] is None:
                out.append(node["f"][: node["k"]])
            else:
                todo += node["sub"]
        return np.concatenate(out)


def neighbour_pairs(points: np.ndarray, reach: float) -> np.ndarray:
    """All index pairs (i < j) of points at most ``reach`` apart, found by a sorted grid."""
    cells = np.floor(points / reach).astype(np.int64)
    code = lambda c: (c[:, 0] * 73_856_093) ^ (c[:, 1] * 19_349_663) ^ (c[:, 2] * 83_492_791)
    own = code(cells)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    found = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dz in (-1, 0, 1):
                want = code(cells + np.array([dx, dy, dz]))
                lo, hi = np.searchsorted(ranked, want), np.searchsorted(ranked, want, side="right")
                n = hi - lo
                i = np.repeat(np.arange(len(points)), n)
                j = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                keep = i < j
                i, j = i[keep], j[keep]
                keep = ((points[i] - points[j]) ** 2).sum(1) <= reach * reach
                found.append(np.stack([i[keep], j[keep]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def farthest(feature: np.ndarray) -> float:
    """How far the feature's box reaches from its centre."""
    centre = feature[1:4] / feature[0]
    return float(np.linalg.norm(np.maximum(feature[8:] - centre, centre - feature[5:8])))


def ward(features: np.ndarray, reach: float, extent: float, radius: float) -> np.ndarray:
    """Agglomerate features by Ward's criterion (least growth of squared error first).

    Only features whose centres lie within ``reach`` merge; no cluster's box reaches further than ``extent`` from its
    centre, and no cluster's root-mean-square radius passes ``radius``.
    """
    live = {i: features[i] for i in range(len(features))}
    links: dict[int, set[int]] = {i: set() for i in live}
    heap: list[tuple[float, int, int]] = []

    def push(i: int, j: int) -> None:
        a, b = live[i], live[j]
        gap = a[1:4] / a[0] - b[1:4] / b[0]
        d2 = float(gap @ gap)
        if d2 > reach * reach:
            return
        both = both_of(a, b)
        centre = both[1:4] / both[0]
        if both[4] / both[0] - centre @ centre <= radius * radius and farthest(both) <= extent:
            heapq.heappush(heap, (a[0] * b[0] / both[0] * d2, i, j))

    for i, j in neighbour_pairs(features[:, 1:4] / features[:, :1], reach):
        links[int(i)].add(int(j))
        links[int(j)].add(int(i))
        push(int(i), int(j))
    new = len(features)
    while heap:
        _, i, j = heapq.heappop(heap)
        if i not in live or j not in live:
            continue
        both = both_of(live.pop(i), live.pop(j))
        around = (links.pop(i) | links.pop(j)) & live.keys()
        live[new], links[new] = both, around
        for k in around:
            links[k].add(new)
            push(new, k)
        new += 1
    return np.array(list(live.values())) if live else np.empty((0, len(NAMES)))


def each_group(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` on the rows of each key, one group after another in a task's stream: for very many small groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the last key so far
        for batch in batches:
            if not len(batch):
                continue
            names = batch[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(1)])
            out = []
            if held and (held[0][keys].iloc[0].to_numpy() != names[0]).any():
                out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                held = []
            for start, end in zip(starts, [*starts[1:], None]):
                held.append(batch.iloc[start:end])
                if end is not None:
                    out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
            if out:
                yield pd.concat(out)
        if held:
            yield work(pd.concat(held))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or the few bytes would be put in one task
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def unit_positions(world: DataFrame, id_col: str = "repo_id") -> DataFrame:
    """``(id, x, y, z)`` of records with a position; null, NaN or infinite angles, and null ids, are none.

    ``phi`` may be any number of turns off. Repeated rows of an id count once, at the position of the smallest angles.
    """
    ok = [F.col(id_col).isNotNull()]
    for c in ("theta", "phi"):
        ok += [F.col(c).isNotNull(), ~F.isnan(F.col(c).cast("double")), F.abs(F.col(c).cast("double")) < float("inf")]
    rows = world
    for condition in ok:
        rows = rows.where(condition)
    one = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col("theta").cast("double").alias("t"), F.col("phi").cast("double").alias("p"))).alias("s"))
    theta, phi = F.col("s.t"), F.col("s.p")
    return one.select("id", (F.sin(theta) * F.cos(phi)).alias("x"), F.cos(theta).alias("y"), (F.sin(theta) * F.sin(phi)).alias("z"))


def cell(side: float, names: tuple[str, str, str] = ("gx", "gy", "gz")) -> list:
    return [F.floor(F.col(c) / side).alias(g) for c, g in zip("xyz", names)]


def centres(points: DataFrame, angle: float, region: int = 16) -> DataFrame:
    """``(cx, cy, cz, n)``: centres of the agglomerated clusters; every record lies within ``EXTENT`` angles of one.

    Tasks hand on feature summaries only: their number is bounded by a region's size over the leaf's, however
    many records lie in it. Every feature belongs to one region of each round and so to one cluster; a cluster cut at an
    edge in one round lies inside a region in the next, for the regions are shifted by a third of their side.
    """
    side = region * angle

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(LEAF * angle)
        for batch in batches:
            if len(batch):
                # what falls in one cell becomes one feature before it is inserted
                for row in collapsed(single(batch[["x", "y", "z"]].to_numpy(), np.ones(len(batch))), CELL * angle):
                    tree.add(row)
        yield pd.DataFrame(tree.leaves(), columns=NAMES)

    def agglomerate(group: pd.DataFrame) -> pd.DataFrame:
        rows = group[NAMES].to_numpy()
        if len(rows) == 1:
            return pd.DataFrame(rows, columns=NAMES)
        tree = FeatureTree(LEAF * angle)
        for row in rows[np.lexsort(rows.T[::-1])]:
            tree.add(row)
        return pd.DataFrame(ward(tree.leaves(), EXTENT * angle, EXTENT * angle, SPREAD * angle), columns=NAMES)

    features = points.select("x", "y", "z").mapInPandas(build, FEATURE)
    for shift in (0, side / 3, 2 * side / 3):
        at = [F.floor((F.col(c) / F.col("n") + shift) / side).alias(g) for c, g in (("lx", "gx"), ("ly", "gy"), ("lz", "gz"))]
        features = each_group(features.select("*", *at), ["gx", "gy", "gz"], agglomerate, FEATURE)
    return features.select(*[(F.col(l) / F.col("n")).alias(c) for l, c in (("lx", "cx"), ("ly", "cy"), ("lz", "cz"))], "n")


def with_number(middle: DataFrame) -> DataFrame:
    """Centres with a key made of their places."""
    return middle.withColumn("centre", F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("cx", "cy", "cz")]), 256))


def near_centres(points: DataFrame, middle: DataFrame, reach: float) -> DataFrame:
    """Every (record, centre) at most ``reach`` apart: centres go to the 27 cells around them, records to their own."""
    around = F.explode(F.array([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = with_number(middle).withColumn("s", around)
    spread = spread.select("centre", "cx", "cy", "cz", *[(F.floor(F.col(c) / reach) + F.col(f"s.{s}")).alias(g) for c, s, g in (("cx", "a", "gx"), ("cy", "b", "gy"), ("cz", "c", "gz"))])
    joined = points.select("*", *cell(reach)).join(spread, ["gx", "gy", "gz"])
    gap = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("x", "cx"), ("y", "cy"), ("z", "cz"))), F.lit(0.0))
    return joined.withColumn("gap", F.sqrt(gap)).where(F.col("gap") <= reach).drop("gx", "gy", "gz")


def assign(points: DataFrame, middle: DataFrame, angle: float) -> DataFrame:
    """``(id, centre, gap)``: each record with its nearest centre; ties go to the smaller centre key."""
    best = near_centres(points, middle, (EXTENT + 1e-6) * angle).groupBy("id").agg(F.min(F.struct("gap", "centre")).alias("m"))
    return best.select("id", "m.centre", "m.gap")


def cluster_report(world: DataFrame, angle: float = 0.001, typical: int = 3, id_col: str = "repo_id") -> DataFrame:
    """``(cluster_key, size, radius, typical_ids)`` of every agglomerated cluster.

    ``cluster_key`` is the smallest id assigned, ``typical_ids`` the members nearest the centre in that order
    (ties by id), ``radius`` the largest distance to it. Sizes of all clusters add up to the records with a position.
    """
    points = materialise(unit_positions(world, id_col), "cluster-points")
    placed = assign(points, centres(points, angle), angle)
    total = placed.groupBy("centre").agg(F.min("id").alias("cluster_key"), F.count(F.lit(1)).alias("size"), F.max("gap").alias("radius"))
    nearest = W.partitionBy("centre").orderBy("gap", "id")
    # a literal bound on row_number is applied before the shuffle too, so a cluster of any size sends few rows
    top = placed.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= typical)
    ids = top.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical_ids"))
    return total.join(ids, "centre").select("cluster_key", "size", "radius", "typical_ids")


def box_gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest distance that points of one box and of others may have."""
    least = np.maximum(np.maximum(los - hi, lo - his), 0)
    most = np.maximum(np.abs(his - lo), np.abs(hi - los))
    return np.sqrt((least * least).sum(-1)), np.sqrt((most * most).sum(-1))


def any_pair(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, test, step: int = 200) -> bool:
    """Whether ``test`` holds for the box gaps of any pair of two index sets; a few rows of distances at a time."""
    return any(test(*box_gaps(lo[a[i : i + step], None], hi[a[i : i + step], None], lo[b], hi[b])).any() for i in range(0, len(a), step))


NONE, CLIQUE, UNSURE = 0, 1, 2


def clique_of(lead: int, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, reach: float, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Whether ``lead``'s group is a clique with nothing similar outside, the group, and those that share its fate.

    Boxes stand for the records in them. ``CLIQUE`` and ``NONE`` are certain whatever the records' places in their boxes;
    ``UNSURE`` is left where these decide. Boxes of one position each are never unsure.
    """
    closest, widest = box_gaps(lo[lead], hi[lead], lo, hi)
    maybe, sure = closest <= reach, widest <= reach
    sure[lead] = True
    group, core = np.flatnonzero(maybe), np.flatnonzero(sure)
    if n[group].sum() < least:
        return NONE, group, core
    around = np.flatnonzero(~maybe & (closest <= 2 * reach))
    if len(group) == len(core):
        apart = any_pair(group, group, lo, hi, lambda _, most: most > reach)
        if not apart and not any_pair(around, group, lo, hi, lambda gap, _: gap <= reach):
            return CLIQUE, group, core
    if any_pair(core, core, lo, hi, lambda gap, _: gap > reach) or any_pair(around, core, lo, hi, lambda _, most: most <= reach):
        return NONE, group, core
    return UNSURE, group, core


def isolated(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, ids: np.ndarray, leads: np.ndarray, reach: float, least: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """``(members, keys, unsure)``: boxes in cliques that hold one of ``leads``, each clique's smallest id, and whether any stayed open.

    All that is near a leader for certain shares its fate, for it is connected to it, so few leaders are tried
    however many records there are, and no list of pairs is made.
    """
    settled = np.zeros(len(n), bool)
    members, keys, unsure = [], [], False
    for lead in leads:
        if settled[lead]:
            continue
        verdict, group, core = clique_of(lead, lo, hi, n, reach, least)
        settled[core] = True
        unsure |= verdict == UNSURE
        if verdict == CLIQUE:
            members.append(group)
            keys.append(np.full(len(group), ids[group].min()))
    none = np.empty(0, np.int64)
    return (np.concatenate(members), np.concatenate(keys), unsure) if members else (none, none, unsure)


def cliques(world: DataFrame, angle: float = 0.001, least: int = 5, id_col: str = "repo_id") -> DataFrame:
    """``(repo_id, cluster_key)`` of groups of at least ``least`` records all within ``angle`` of one another and of no other record.

    Every record lies within ``EXTENT`` angles of a centre of the agglomeration, so all similar to it, and all similar to
    those, lie within ``EXTENT`` + 2. That neighbourhood is first looked at in cells of ``FINE`` angles, of which it has
    a bounded number however many records lie there; only where the cells leave a verdict open are the positions themselves
    looked at, copies of a position as one entry. An empty table gives no groups.
    """
    points = materialise(unit_positions(world, id_col), "clique-points")
    middle = materialise(centres(points, angle), "clique-centres")
    chord, side, slack = 2 * np.sin(angle / 2), FINE * angle, 2 * FINE * angle
    edges = [f(c).alias(f"{c}{i}") for i, f in ((0, F.min), (1, F.max)) for c in "xyz"]
    boxes = points.groupBy(*cell(side, ("fx", "fy", "fz"))).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"), *edges)
    boxes = boxes.select("*", *[((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c) for c in "xyz"])
    spots = points.groupBy(*[F.round(c, 12).alias(c) for c in "xyz"]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))

    def parts(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return group["n"].to_numpy(), group["least_id"].to_numpy()

    def by_cell(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("least_id")
        n, ids = parts(group)
        leads = np.flatnonzero(group["gap"].to_numpy() <= EXTENT * angle + slack)
        members, keys, unsure = isolated(group[["x0", "y0", "z0"]].to_numpy(), group[["x1", "y1", "z1"]].to_numpy(), n, ids, leads, chord, least)
        out = group[["fx", "fy", "fz"]].iloc[members].assign(cluster_key=keys, centre=None)
        return pd.concat([out, pd.DataFrame({"fx": [0], "fy": [0], "fz": [0], "cluster_key": [0], "centre": [group["centre"].iloc[0]]})]) if unsure else out

    def by_spot(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("least_id")
        n, ids = parts(group)
        xyz = group[["x", "y", "z"]].to_numpy()
        leads = np.flatnonzero(group["gap"].to_numpy() <= EXTENT * angle + slack)
        members, keys, _ = isolated(xyz, xyz, n, ids, leads, chord, least)
        return group[["x", "y", "z"]].iloc[members].assign(cluster_key=keys)

    seen = near_centres(boxes, middle, (EXTENT + 2 + 8 * FINE) * angle)
    seen = each_group(seen, ["centre"], by_cell, "fx long, fy long, fz long, cluster_key long, centre string")
    seen = materialise(seen, "clique-cells")
    keyed = points.select("id", *cell(side, ("fx", "fy", "fz")))
    sure = keyed.join(seen.where("centre is null").drop("centre").distinct(), ["fx", "fy", "fz"])
    open_ = with_number(middle).join(seen.where("centre is not null").select("centre").distinct(), "centre", "left_semi")
    looked = each_group(near_centres(spots, open_.drop("centre"), (EXTENT + 2 + 4 * FINE) * angle), ["centre"], by_spot, "x double, y double, z double, cluster_key long")
    rounded = points.select("id", *[F.round(c, 12).alias(c) for c in "xyz"])
    rest = rounded.join(looked.distinct(), ["x", "y", "z"])
    found = sure.select("id", "cluster_key").unionByName(rest.select("id", "cluster_key")).distinct()
    return found.select(F.col("id").alias("repo_id"), "cluster_key")

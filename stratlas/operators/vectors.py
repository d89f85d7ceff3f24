"""Dense vectors: normalising, codecs, whitening, nearest neighbours, purity, spherical k-means."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.session import materialise

QUERY_CHUNK, LIST_ROWS, MOST_LISTS, TRIALS = 4096, 20_000, 3_000, 100


def doubles(v: str | Column) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(doubles(v))


def check_width(df: DataFrame, v: str, width: int) -> DataFrame:
    """Raise while running if a vector has another width."""
    wrong = F.raise_error(F.concat(F.lit("vector of width "), F.size(v).cast("string")))
    return df.withColumn(v, F.when(F.col(v).isNull() | (F.size(v) == width), F.col(v)).otherwise(wrong))


def packed(v: str) -> Column:
    """float32 little-endian bytes of an array column."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(v)


def unpacked(b: str, width: int) -> Column:
    """The array of packed bytes; a wrong length raises and names it."""

    @F.pandas_udf("array<float>")
    def unpack(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if len(x) != 4 * width:
                raise ValueError(f"{len(x)} bytes are no vector of width {width}")
            return np.frombuffer(x, "<f4")

        return s.map(one)

    return unpack(b)


def moments(df: DataFrame, v: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and Gram matrix of a vector column: d + d² numbers per task reach the driver's sum, whatever the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            m = np.stack(batch["v"].to_numpy()).astype(float) if len(batch) else np.empty((0, width))
            n, total, gram = n + len(m), total + m.sum(0), gram + m.T @ m
        flat = np.r_[n, total, gram.ravel()]
        yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    parts = df.where(F.col(v).isNotNull()).select(F.col(v).alias("v")).mapInPandas(run, "i int, x double")
    flat = np.zeros(1 + width + width * width)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r["i"]] = r["x"]
    return int(flat[0]), flat[1 : 1 + width], flat[1 + width :].reshape(width, width)


def fit_whitening(df: DataFrame, v: str, width: int, strip: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``strip`` leading directions to take out, from the Gram matrix of all rows."""
    n, total, gram = moments(df, v, width)
    mean = total / max(n, 1)
    values, vectors = np.linalg.eigh(gram / max(n, 1) - np.outer(mean, mean))
    return mean, vectors[:, np.argsort(values)[::-1][:strip]].T


def whiten(df: DataFrame, v: str, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """Vectors less the mean and the directions, at unit length."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        m = np.stack(s.to_numpy()).astype(float) - mean
        if len(directions):
            m -= (m @ directions.T) @ directions
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.Series(list(np.divide(m, size, out=m, where=size > 0)))

    return df.where(F.col(v).isNotNull()).withColumn(v, run(v))


@dataclass
class Basis:
    """A mean and the leading directions of a set of vectors, to be put to others, too."""

    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, v: str, width: int, k: int = 48) -> Basis:
        """The ``k`` directions of largest variance, from the Gram matrix of all rows; a direction's largest entry is positive."""
        mean, axes = fit_whitening(df, v, width, min(k, width))
        sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
        return cls(mean, axes * np.where(sign == 0, 1, sign)[:, None])

    def reduce(self, df: DataFrame, v: str) -> DataFrame:
        """``df`` with ``v`` less the mean along each direction; rows without a vector keep null, and one of another width raises."""
        mean, axes = self.mean, self.axes

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else (np.asarray(x, float) - mean) @ axes.T for x in s])

        return df.withColumn(v, run(v))

    def to_json(self) -> str:
        return json.dumps({"mean": self.mean.tolist(), "axes": self.axes.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Basis:
        held = json.loads(text)
        return cls(np.array(held["mean"]), np.array(held["axes"]))


def sums_by(df: DataFrame, v: str, width: int, *keys: str) -> DataFrame:
    """``(keys, n, total, squares)``: count, vector sum and summed squared lengths; the sums combine on the map side."""
    cols = [F.sum(F.col(v)[i].cast("double")).alias(f"__{i}") for i in range(width)]
    rows = df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(dot(F.col(v), F.col(v))).alias("squares"), *cols)
    return rows.select(*keys, "n", "squares", F.array(*[f"__{i}" for i in range(width)]).alias("total"))


def pair_cosine(sums: DataFrame) -> DataFrame:
    """Mean cosine of all pairs of unit vectors of each group, in closed form: (|Σv|² - Σ|v|²) / (n (n - 1))."""
    pairs = F.col("n") * (F.col("n") - 1)
    return sums.withColumn("cosine", F.when(pairs > 0, (dot(F.col("total"), F.col("total")) - F.col("squares")) / pairs))


def purity(df: DataFrame, v: str, label: str, width: int) -> DataFrame:
    """``(mean_within, baseline, lift, median_size, ratio, weakest)`` of a labelling; groups under two don't count."""
    within = pair_cosine(sums_by(df.where(F.col(label).isNotNull()), v, width, label)).where("n > 1")
    stats = within.agg(F.avg("cosine").alias("w"), F.percentile("n", F.lit(0.5)).alias("m"), F.min_by(label, F.struct("cosine", label)).alias("weakest"))
    base = pair_cosine(sums_by(df, v, width)).select("cosine")
    rows = stats.join(F.broadcast(base), F.lit(True))
    ratio = F.when(F.abs("cosine") > 0.02, F.col("w") / F.col("cosine"))
    return rows.select(F.round("w", 6).alias("mean_within"), F.round("cosine", 6).alias("baseline"), F.round(F.col("w") - F.col("cosine"), 6).alias("lift"), F.col("m").alias("median_size"), F.round(ratio, 6).alias("ratio"), "weakest")


def lift_threshold(median_size: Column) -> Column:
    """The lift under which a labelling of that median size is called weak."""
    return 0.30 / (1 + F.log10(F.greatest(median_size, F.lit(1))))


def centroids(df: DataFrame, v: str, label: str, width: int) -> DataFrame:
    """``(label, n, centre, tightness)``: unit mean and mean cosine to it (the resultant length) of unit vectors."""
    rows = sums_by(df.where(F.col(label).isNotNull()), v, width, label)
    return rows.select(label, "n", normalised(F.col("total")).alias("centre"), (norm(F.col("total")) / F.col("n")).alias("tightness"))


def search(df: DataFrame, id_col: str, v: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows of largest cosine with one query vector: a projection and a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col(v), q) / F.nullif(norm(F.col(v)) * float(np.linalg.norm(query)), F.lit(0.0))
    return df.select(id_col, score.alias("score")).where("score is not null").orderBy(F.desc(F.round("score", 9)), id_col).limit(k)


def nearest(queries: DataFrame, base: DataFrame, id_col: str, v: str, k: int) -> DataFrame:
    """``(query, id, cosine, r)``: the exact ``k`` nearest of every query among all rows.

    A stated query set against all rows, in blocks: ``QUERY_CHUNK`` queries at a time travel to every task (a size bound of
    chunk × width), each task keeps its k best per query, and the tasks' bests are merged. A row isn't its own neighbour.
    """
    numbered = queries.select(F.col(id_col).alias("q"), doubles(v).alias("v")).where("v is not null").orderBy("q")
    parts = None
    total = numbered.count()
    for start in range(0, max(total, 1), QUERY_CHUNK):
        rows = numbered.offset(start).limit(QUERY_CHUNK).collect()
        if not rows:
            break
        shared = base.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in rows]), unit_rows(np.array([r["v"] for r in rows]))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                own = batch["id"].to_numpy()
                cosine = matrix @ unit_rows(np.stack(batch["v"].to_numpy()).astype(float)).T
                cosine[ids[:, None] == own[None]] = -np.inf
                m = min(k, cosine.shape[1])
                top = np.argpartition(-cosine, m - 1, axis=1)[:, :m]
                yield pd.DataFrame({"query": np.repeat(ids, m), "id": own[top].ravel(), "cosine": np.take_along_axis(cosine, top, 1).ravel()})

        part = base.select(F.col(id_col).alias("id"), doubles(v).alias("v")).where("v is not null").mapInPandas(run, "query long, id long, cosine double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return base.sparkSession.createDataFrame([], "query long, id long, cosine double, r int")
    order = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id")
    return parts.where("cosine > -2").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m, dtype=float), where=size > 0)


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of an inverted-list index by spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    x = unit_rows(sample)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, unit_rows(total), c)
    return c


class ListIndex:
    """Inverted lists over all rows: a row lies in its nearest list, a query looks into its ``probes`` nearest ones.

    Without ``probes``, their number is measured: of the true neighbours (by brute force) of ``TRIALS`` rows, at least ``recall``
    must lie in the lists looked into.
    """

    def __init__(self, base: DataFrame, id_col: str, v: str, lists: int | None = None, sample_rows: int = 20_000, probes: int | None = None, recall: float = 0.97):
        """Fitted on a sample of ``sample_rows`` rows at most, or 16 for each list (documented bounds); every row with a vector is indexed.

        Without ``lists`` there are about as many as the root of the number of rows, and ``MOST_LISTS`` at most, for the
        driver fits them; beyond that lists grow and are searched in chunks of ``LIST_ROWS``.
        """
        self.id_col, self.v = id_col, v
        n = max(1, base.count())
        lists = lists or min(MOST_LISTS, max(8, round(n**0.5)))
        sample_rows = max(sample_rows, 16 * lists)
        share = min(1.0, 1.1 * sample_rows / n)
        hit = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = [r[0] for r in base.where(hit & F.col(v).isNotNull()).select(doubles(v)).limit(sample_rows).collect()]
        self.centres = fit_lists(np.array(sample), lists) if sample else np.empty((0, 0))
        rows = base.select(F.col(id_col).alias("id"), doubles(v).alias("v")).where("v is not null")
        chunks = max(1, -(-n // (LIST_ROWS * max(1, len(self.centres)))))
        placed = self._place(rows, 1).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        self.chunks = chunks
        self.lists = materialise(placed, "vector-lists")
        self.probes = probes or self._measured(recall)

    def _measured(self, recall: float, k: int = 10) -> int:
        """The fewest lists that hold ``recall`` of the true neighbours of ``TRIALS`` rows."""
        if not len(self.centres):
            return 1
        rows = self.lists.select("id", "v")
        trials = rows.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(TRIALS)
        near = nearest(trials, rows, "id", "v", k).join(self.lists.select("id", "list"), "id").select("query", "list").collect()
        order = {r["id"]: np.argsort(-(unit_rows(np.array([r["v"]])) @ self.centres.T)[0]).tolist() for r in trials.collect()}
        depth = np.sort([order[r["query"]].index(r["list"]) + 1 for r in near if r["query"] in order]) if near else np.array([1])
        return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)])

    def _place(self, rows: DataFrame, probes: int) -> DataFrame:
        centres = self.centres

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(centres):
                    continue
                near = np.argsort(-(unit_rows(np.stack(batch["v"].to_numpy()).astype(float)) @ centres.T), axis=1)[:, :probes]
                out = batch.loc[batch.index.repeat(near.shape[1])].reset_index(drop=True)
                out["list"] = near.ravel().astype("int32")
                yield out[["id", "v", "list"]]

        return rows.mapInPandas(run, "id long, v array<double>, list int")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query, id, cosine, r)``; lists too long for one task are cut into chunks, each searched by itself."""
        asked = self._place(queries.select(F.col(self.id_col).alias("id"), doubles(self.v).alias("v")).where("v is not null"), self.probes)
        parts = max(1, -(-asked.count() // (LIST_ROWS * max(1, len(self.centres)))))  # queries of a list in chunks, too
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))))
        lists = self.lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": [], "id": [], "cosine": []}).astype({"query": "int64", "id": "int64"})
            ids, own = a["id"].to_numpy(), b["id"].to_numpy()
            cosine = unit_rows(np.stack(a["v"].to_numpy())) @ unit_rows(np.stack(b["v"].to_numpy())).T
            cosine[ids[:, None] == own[None]] = -2
            m = min(k, len(own))
            top = np.argpartition(-cosine, m - 1, axis=1)[:, :m]
            return pd.DataFrame({"query": np.repeat(ids, m), "id": own[top].ravel(), "cosine": np.take_along_axis(cosine, top, 1).ravel()})

        found = asked.groupBy("list", "chunk", "part").cogroup(lists.groupBy("list", "chunk", "part")).applyInPandas(run, "query long, id long, cosine double")
        order = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id")
        return found.where("cosine > -1.5").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def knn_edges(neighbours: DataFrame, most_distance: float, k: int) -> DataFrame:
    """``(a, b, weight)`` of mutual neighbours within a cosine distance, once with a < b; weight 1 - distance to 4 places."""
    near = neighbours.where((F.col("r") <= k) & (1 - F.col("cosine") <= most_distance))
    both = near.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("c"))
    return both.where("n = 2").select("a", "b", F.round("c", 4).alias("weight"))


def adopt(orphans: DataFrame, anchors: DataFrame, id_col: str, v: str, label: str, index: ListIndex | None = None) -> DataFrame:
    """``(id, label)``: each orphan takes the label of its most similar anchor.

    Exact, in blocks of orphans against all anchors, for a bounded set of orphans; orphans that grow with the data go
    through an ``index`` of the anchors instead, at its recall. Orphans and anchors without a vector take and give nothing.
    """
    found = index.nearest(orphans, 1) if index else nearest(orphans, anchors, id_col, v, 1)
    best = found.select(F.col("query").alias("id"), F.col("id").alias("anchor"))
    return best.join(anchors.select(F.col(id_col).alias("anchor"), label), "anchor").select("id", label)


def spherical_kmeans(df: DataFrame, id_col: str, v: str, k: int, width: int, rounds: int = 50, weight: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """``(id, label)`` and the centres: Lloyd's rounds over all rows, farthest-point start, empty centres moved to the worst row.

    Each round is one map with the k centres and one sum per centre; only k·width numbers reach the driver. For the start
    it gets the worst rows in bounded pools: new centres only bring rows nearer, so the worst of a pool is the worst of all
    while it is no better than the pool's last was.
    """
    rows = materialise(df.where(F.col(v).isNotNull()).select(F.col(id_col).cast("long").alias("id"), normalised(F.col(v)).alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), "kmeans-rows")
    first = rows.orderBy("id").limit(1).collect()
    if not first:
        return rows.select("id", F.lit(0).alias("label")), np.empty((0, width))
    centres = np.array([first[0]["v"]])

    def placed(c: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    cosine = np.stack(batch["v"].to_numpy()) @ c.T
                    yield batch.assign(label=cosine.argmax(1).astype("int32"), cosine=cosine.max(1))

        return rows.mapInPandas(run, "id long, v array<double>, w double, label int, cosine double")

    def worst(c: np.ndarray) -> np.ndarray:
        return np.array(placed(c).orderBy(F.round("cosine", 9), "id").limit(1).collect()[0]["v"])

    pool = max(1000, 60_000 // width)
    while len(centres) < k:
        far = placed(centres).orderBy(F.round("cosine", 9), "id").limit(pool).select("id", "v", "cosine").toArrow().combine_chunks()
        v, cosine, ids = matrix_of(pa.concat_arrays(far["v"].chunks), width), np.round(far["cosine"].to_numpy(), 9), far["id"].to_numpy()
        last = (cosine[-1], ids[-1])
        while len(centres) < k:
            worst_of = np.flatnonzero(cosine == cosine.min())
            at = worst_of[ids[worst_of].argmin()]
            if len(far) == pool and (cosine[at], ids[at]) > last:
                break
            centres = np.vstack([centres, v[at]])
            cosine = np.maximum(cosine, np.round(v @ v[at], 9))
    names = [f"s{i}" for i in range(width)]

    def sums(c: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(c), width))
            seen = np.zeros(len(c), bool)
            for batch in batches:
                m, w = matrix_of(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
                label = (m @ c.T).argmax(1)
                seen[label] = True
                for i in range(width):
                    total[:, i] += np.bincount(label, weights=m[:, i] * w, minlength=len(c))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, i]) for i in range(width)]], names=["label", *names])

        return rows.mapInArrow(run, "label int, " + ", ".join(f"{n} double" for n in names)).groupBy("label").agg(*[F.sum(n).alias(n) for n in names])

    def labels(c: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = (matrix_of(batch.column(1), width) @ c.T).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32())], names=["id", "label"])

        return rows.mapInArrow(run, "id long, label int")

    for _ in range(rounds):
        fresh = centres.copy()
        seen = set()
        for r in sums(centres).collect():  # a row per centre; each task sends as many
            total = np.array([r[n] for n in names])
            size = np.linalg.norm(total)
            seen.add(r["label"])
            if size > 1e-12:
                fresh[r["label"]] = total / size
        for j in set(range(k)) - seen:
            fresh[j] = worst(fresh)
        moved = float(np.abs(fresh - centres).max())
        centres = fresh
        if moved < 1e-9:
            break
    return labels(centres), centres


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow list column, none of them null, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def recommended_strip(df: DataFrame, v: str, width: int, most: int = 8, enough: float = 0.02) -> tuple[int, list[float]]:
    """The fewest leading directions to take out so that all pairs' mean cosine falls under ``enough``, and the cosines tried."""
    mean, axes = fit_whitening(df, v, width, most)
    rows = df.select(doubles(v).alias("v"))
    tried: list[float] = []
    for k in range(most + 1):
        tried.append(pair_cosine(sums_by(whiten(rows, "v", mean, axes[:k]), "v", width)).first()["cosine"] or 0.0)
        if abs(tried[-1]) < enough:
            return k, tried
    return most, tried

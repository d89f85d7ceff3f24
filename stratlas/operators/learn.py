"""Features, stratified teaching samples, splits, boosted trees and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratlas.functions.bands import ACTIVITY_BANDS, STAR_BANDS, band_of, days_before
from stratlas.functions.judgement import gives_popularity_away
from stratlas.operators.ordering import quantiles

#: Languages with a feature of their own.
LANGUAGES = (
    "python", "javascript", "typescript", "java", "go", "c++", "c", "rust", "ruby", "php", "c#", "shell", "swift", "kotlin", "scala", "html", "css",
    "jupyter notebook", "dart", "r", "lua", "perl", "haskell", "elixir", "zig",
)
MOST_RATIO = 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b within ±1e6, 0 where b is 0 or null."""
    value = F.coalesce(a, F.lit(0)) / F.nullif(b, F.lit(0))
    return F.greatest(F.lit(-MOST_RATIO), F.least(F.lit(MOST_RATIO), F.coalesce(value, F.lit(0.0))))


def plain_name(language: str) -> str:
    return language.replace(" ", "_").replace("+", "p").replace("#", "sharp").replace("-", "_")


def features(repo: DataFrame, now: str) -> DataFrame:
    """``id`` and numeric features: sizes, ages, ratios and flags, one per language, other and missing.

    A project never pushed has -1 days since its push; nulls are 0 elsewhere.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("double")
    language = F.lower(F.trim("language"))
    age, idle = days_before("created_at", now), days_before("pushed_at", now)
    columns = {
        "stars": n("stars"), "log_stars": F.log1p(n("stars")), "stars_90d": n("stars_90d"), "forks": n("forks"), "open_issues": n("open_issues"),
        "criticality": n("criticality"), "age_days": F.coalesce(age, F.lit(-1.0)), "idle_days": F.coalesce(idle, F.lit(-1.0)),
        "fork_ratio": ratio(n("forks"), n("stars")), "issue_ratio": ratio(n("open_issues"), n("stars")), "velocity_ratio": ratio(n("stars_90d"), n("stars")),
        "stars_per_day": ratio(n("stars"), age), "readme_length": length("readme_raw"), "log_readme_length": F.log1p(length("readme_raw")),
        "clean_length": length("clean_text"), "description_length": length("description"), "name_length": length("full_name"),
        "name_hyphens": F.length("full_name") - F.length(F.replace("full_name", F.lit("-"), F.lit(""))).cast("double"),
        "n_topics": F.size(F.coalesce("topics", F.array())).cast("double"), "clean_reduction": n("clean_reduction"),
        "n_dropped": F.size(F.coalesce("dropped_sections", F.array())).cast("double"), "has_license": (F.coalesce(F.col("license"), F.lit("")) != "").cast("double"),
        "has_description": (F.coalesce(F.col("description"), F.lit("")) != "").cast("double"), "is_fork": flag("is_fork"), "is_archived": flag("is_archived"),
        "low_signal": flag("low_signal"), "non_english": flag("non_english"), "code_share": ratio(length("readme_raw") - length("clean_text"), length("readme_raw")),
        "text_per_topic": ratio(length("clean_text"), F.size(F.coalesce("topics", F.array()))), "never_pushed": F.col("pushed_at").isNull().cast("double"),
        "description_share": ratio(length("description"), length("clean_text")), "issues_per_fork": ratio(n("open_issues"), n("forks")), "idle_share": ratio(idle, age),
    }
    for name in LANGUAGES:
        columns[f"language_{plain_name(name)}"] = F.coalesce(language == name, F.lit(False)).cast("double")
    columns["language_other"] = (F.coalesce(language, F.lit("")) != "").cast("double") * (~F.coalesce(language.isin(*LANGUAGES), F.lit(False))).cast("double")
    columns["language_missing"] = (F.coalesce(language, F.lit("")) == "").cast("double")
    return repo.select("id", *[c.cast("double").alias(name) for name, c in columns.items()])


def blindfolded(table: DataFrame) -> DataFrame:
    """The features without those that give popularity away."""
    return table.drop(*gives_popularity_away(table.columns))


def constants(table: DataFrame) -> DataFrame:
    """``(feature, variance)`` of every feature, in one pass."""
    names = [c for c in table.columns if c != "id"]
    one = table.agg(*[F.var_pop(f"`{c}`").alias(str(i)) for i, c in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(str(i)).alias("variance")) for i, c in enumerate(names)])))


def teaching_strata(repo: DataFrame, world: DataFrame, now: str) -> DataFrame:
    """``(id, s, d, a)``: bands of stars and activity and the domain; unknown ones default as candidates do."""
    place = world.groupBy(F.col("repo_id").alias("id")).agg(F.min("domain").alias("d"))
    rows = repo.select("id", "stars", "pushed_at").join(place, "id", "left")
    s, a = band_of(F.coalesce("stars", F.lit(0)), STAR_BANDS), band_of(F.coalesce(days_before("pushed_at", now), F.lit(3650.0)), ACTIVITY_BANDS)
    return rows.select("id", s.alias("s"), F.coalesce("d", F.lit(0)).alias("d"), a.alias("a"))


def allocate(sizes: dict[tuple, int], total: int, floor: int = 3) -> dict[tuple, int]:
    """Places per cell in proportion to √size, at least ``floor``, at most the cell; trimmed to ``total`` from the largest."""
    if not sizes:
        return {}
    roots = {k: n**0.5 for k, n in sizes.items() if n > 0}
    scale = total / sum(roots.values())
    out = {k: min(sizes[k], max(floor, round(r * scale))) for k, r in roots.items()}
    order = sorted(out, key=lambda k: (-sizes[k], k))
    while (over := sum(out.values()) - total) > 0:
        trimmed = [k for k in order if out[k] > floor]
        if not trimmed:
            break
        for k in trimmed[:over]:
            out[k] -= 1
    while (left := total - sum(out.values())) > 0:
        spare = [k for k in order if out[k] < sizes[k]]
        if not spare:
            break
        for k in spare[:left]:
            out[k] += 1
    return out


def stratum_sizes(strata: DataFrame, *keys: str) -> dict[tuple, int]:
    """Rows per cell; cells are bounded by the bands and domains."""
    return {tuple(r[k] for k in keys): r["n"] for r in strata.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}


def take_smallest(strata: DataFrame, keys: tuple[str, ...], places: dict[tuple, int], seed: int) -> DataFrame:
    """``(id, keys)``: per cell its number of rows with the smallest hashes; the same rows on every run.

    A cell's rows are cut to hash buckets that reach its number before anything is sorted, so a cell with a third of
    all rows sorts few of them.
    """
    spark = strata.sparkSession
    types = {f.name: f.dataType.simpleString() for f in strata.schema}
    rows = spark.createDataFrame([(*k, n) for k, n in places.items() if n > 0] or [], ", ".join(f"{k} {types[k]}" for k in keys) + ", places long")
    work = strata.join(F.broadcast(rows), list(keys)).withColumn("h", F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}")))).withColumn("bucket", F.substring("h", 1, 3))
    counts = work.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("places").alias("places"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where("before < places").groupBy(*keys).agg(F.max("bucket").alias("last"))
    low = work.join(F.broadcast(last), list(keys)).where("bucket <= last")
    order = W.partitionBy(*keys).orderBy("h", "id")
    return low.withColumn("r", F.row_number().over(order)).where("r <= places").select("id", *keys)


def teaching_sample(strata: DataFrame, total: int, seed: int = 42) -> DataFrame:
    keys = ("s", "d", "a")
    return take_smallest(strata, keys, allocate(stratum_sizes(strata, *keys), total), seed)


def split(strata: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``(id, is_test)``: ``share`` of every cell, at least one row of cells with more than one, goes to the test."""
    keys = ("s", "d", "a")
    sizes = stratum_sizes(strata, *keys)
    test = take_smallest(strata, keys, {k: max(1, round(n * share)) if n > 1 else 0 for k, n in sizes.items()}, seed)
    return strata.select("id").join(test.select("id", F.lit(True).alias("t")), "id", "left").select("id", F.coalesce("t", F.lit(False)).alias("is_test"))


def bin_edges(table: DataFrame, names: list[str], bins: int = 64) -> dict[str, list[float]]:
    """Distinct quantile edges of each feature, exact and interpolated, to six places; ``bins`` - 1 at most."""
    long = table.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(names)])))
    rows = quantiles(long, "value", [i / bins for i in range(1, bins)], F.col("feature")).collect()  # a row per feature
    found = {int(r["g"]): sorted({round(x, 6) for x in r["q"]}) for r in rows}
    return {c: found.get(i, []) for i, c in enumerate(names)}


class Boosted:
    """Trees of depth 3 fitted to residuals on binned features, with subsampling and early stopping."""

    def __init__(self, rate: float = 0.06, trees: int = 400, depth: int = 3, subsample: float = 0.8, least: int = 12, patience: int = 25, seed: int = 0):
        self.rate, self.most, self.depth, self.subsample, self.least, self.patience, self.seed = rate, trees, depth, subsample, least, patience, seed
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 8], order[len(y) // 8 :]
        self.base = float(y[used].mean()) if len(used) else 0.0
        now = np.full(len(y), self.base)
        best, at = np.inf, 0
        for n in range(self.most):
            rows = used[rng.random(len(used)) < self.subsample]
            tree = self._grow(x, y - now, rows, self.depth)
            self.trees.append(tree)
            now += self.rate * self._walk(tree, x)
            error = float(((y[held] - now[held]) ** 2).mean()) if len(held) else 0.0
            if error < best - 1e-9:
                best, at = error, n
            elif n - at >= self.patience:
                break
        self.trees = self.trees[: at + 1]
        return self

    def _grow(self, x, target, rows, depth):
        value = float(target[rows].mean()) if len(rows) else 0.0
        if not depth or len(rows) < 2 * self.least:
            return value
        t, best = target[rows], (0.0, -1, -1)
        total = t.sum()
        for j in range(x.shape[1]):
            b = x[rows, j]
            count = np.bincount(b, minlength=64).cumsum()[:-1]
            left = np.bincount(b, weights=t, minlength=64).cumsum()[:-1]
            ok = (count >= self.least) & (len(rows) - count >= self.least)
            if ok.any():
                gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(len(rows) - count, 1) - total**2 / len(rows), -1)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            return value
        go = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, target, rows[go], depth - 1), self._grow(x, target, rows[~go], depth - 1))

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        go = x[:, tree[0]] <= tree[1]
        return np.where(go, self._walk(tree[2], x), self._walk(tree[3], x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._walk(tree, x)
        return np.clip(out, 0, 100)


def binned(m: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """How many edges lie at or below each value, per column."""
    return np.stack([np.searchsorted(np.array(e), m[:, j], side="right") for j, e in enumerate(edges)], 1).astype(np.int64)


def train(table: DataFrame, targets: DataFrame, bound: int = 50_000) -> dict[str, tuple[Boosted, list[str], list[list[float]]]]:
    """A model per target column, fitted on at most ``bound`` labelled rows (a documented bound; those of smallest hashes)."""
    names = [c for c in table.columns if c != "id"]
    edges = bin_edges(table, names)
    rows = table.join(targets, "id")
    share = min(1.0, 1.2 * bound / max(1, targets.count()))
    taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(bound).toPandas().sort_values("id")
    cuts = [edges[c] for c in names]
    x = binned(taken[names].to_numpy(float), cuts)
    out = {}
    for target in [c for c in targets.columns if c != "id"]:
        known = taken[target].notna().to_numpy()
        out[target] = (Boosted().fit(x[known], taken[target].to_numpy(float)[known]), names, cuts)
    return out


def predicted(table: DataFrame, models: dict) -> DataFrame:
    """``(id, targets…)`` for all rows: the models travel with the task, rows stay where they are."""
    targets = sorted(models)
    shared = table.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"id": batch["id"]}
            for t in targets:
                model, names, cuts = shared.value[t]
                out[t] = model.predict(binned(batch[names].to_numpy(float), cuts)) if len(batch) else np.empty(0)
            yield pd.DataFrame(out)

    return table.mapInPandas(run, "id long, " + ", ".join(f"`{t}` double" for t in targets))


def regression_scores(rows: DataFrame, actual: str, guess: str, baseline: float) -> DataFrame:
    """``(n, rmse, mae, base, r2, beats_baseline)``; the gain must pass the baseline's own noise, base/√(2n)."""
    e = F.col(actual) - F.col(guess)
    b = F.col(actual) - F.lit(baseline)
    one = rows.where(F.col(actual).isNotNull() & F.col(guess).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(b * b)).alias("base"), F.var_pop(actual).alias("v"))
    return one.select("n", "rmse", "mae", "base", (1 - F.col("rmse") * F.col("rmse") / F.nullif("v", F.lit(0.0))).alias("r2"), (F.col("base") - F.col("rmse") > F.col("base") / F.sqrt(2 * F.greatest("n", F.lit(1)))).alias("beats_baseline"))

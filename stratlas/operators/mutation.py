"""Upserts, layer replacement and checkpoints on plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None, coalesce: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``target`` with ``updates`` laid over them by ``keys``.

    A full outer join: columns of an update overwrite, but those in ``coalesce`` only where they aren't null; columns that the
    updates lack stay. Of several updates of a key the last by ``order`` counts. Null keys never match, and stay rows.
    """
    sets = [c for c in updates.columns if c in target.columns and c not in keys]
    if order:
        last = F.max_by(F.struct(*[c for c in updates.columns if c not in keys]), F.struct(*order))
        updates = updates.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*")
    new = updates.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__new_{c}") for c in sets], F.lit(True).alias("__hit"))
    on = None
    for k in keys:
        condition = F.col(k) == F.col(f"__{k}")
        on = condition if on is None else on & condition
    rows = target.join(new, on, "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"__{c}")).alias(c)
        if c not in sets:
            return F.col(c)
        if c in coalesce:
            return F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c)
        return F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)

    return rows.select(*[value(c) for c in target.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with those of ``rows`` whose key it lacks; of rows with the same key one is taken, the smallest."""
    rest = [c for c in target.columns if c not in keys]
    order = F.struct(*[x for c in rest for x in (F.col(c).isNull(), F.col(c))])  # nulls last
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*") if rest else rows.select(*keys).distinct()
    return target.unionByName(one.select(*target.columns).join(target.select(*keys), keys, "left_anti"))


class EmptyLayer(ValueError):
    """A layer that must not be emptied was given no rows."""


def replace_layer(edge: DataFrame, kind: int, rows: DataFrame, allow_empty: bool = False, symmetric: bool = False) -> DataFrame:
    """``edge`` with all edges of ``kind`` replaced by ``rows``, in both directions if ``symmetric``; an empty layer is refused by default."""
    if not allow_empty and rows.isEmpty():
        raise EmptyLayer(f"refusing to empty layer {kind}")
    new = rows.where("src <> dst")
    if symmetric:
        turned = new.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        new = new.unionByName(turned).dropDuplicates(["src", "dst"])
    return edge.where(F.col("kind") != kind).unionByName(new.withColumn("kind", F.lit(kind).cast(edge.schema["kind"].dataType)).select(*edge.columns))


def point_update(target: DataFrame, key: str, values: DataFrame, column: str) -> DataFrame:
    """``column`` of the rows that ``values`` (key, column) names; others keep theirs."""
    new = values.groupBy(F.col(key).alias("__k")).agg(F.max(column).alias("__v"))
    rows = target.join(new, target[key] == F.col("__k"), "left").withColumn(column, F.coalesce("__v", column))
    return rows.select(*target.columns)


def recleaned(repo: DataFrame, pages: DataFrame) -> DataFrame:
    """``repo`` with the pages of ``(full_name, readme_raw)`` laid over it: raw page, clean text, flags, input and hash change together.

    Only the name goes into the new input, for that is all a fetched page comes with. Names match in any case; a
    page without text changes nothing; of several pages of a name the longest counts (ties to the larger).
    """
    from stratlas.functions import text as T

    one = pages.where(F.length(F.trim("readme_raw")) > 0).groupBy(F.lower("full_name").alias("__k")).agg(F.max(F.struct(F.length("readme_raw").alias("n"), "readme_raw")).alias("p"))
    rows = repo.select("id", "full_name", F.lower("full_name").alias("__k")).join(one, "__k")
    none = F.lit(None).cast("string")
    rows = rows.select("id", "full_name", F.col("p.readme_raw").alias("readme_raw"), T.cleaned(F.col("p.readme_raw"), none).alias("c"))
    made = T.embedding_input(F.element_at(F.split("full_name", "/"), -1), none, none, F.array().cast("array<string>"), F.col("c.clean_text"))
    fresh = rows.select("id", "readme_raw", "c.clean_text", "c.low_signal", "c.non_english", F.col("c.reduction").alias("clean_reduction"), F.col("c.dropped").alias("dropped_sections"), made.alias("embedding_input"))
    return merge_upsert(repo, fresh.withColumn("content_hash", F.sha2("embedding_input", 256)), ["id"])


def append_run(runs: DataFrame | None, spark, **values) -> DataFrame:
    """The run log with one more row; columns that a row lacks are null."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row if runs is None else runs.unionByName(row, allowMissingColumns=True)


def advance(state: DataFrame, shard: str, cursor: str | None, rows: int, completed: bool) -> DataFrame:
    """The ingest state after a page: written after the page's rows, so a lost run repeats a page and never skips one."""
    update = state.sparkSession.createDataFrame([(shard, cursor, rows, completed)], "shard string, cursor string, rows_seen long, completed boolean")
    before = state.where(F.col("shard") == shard).agg(F.coalesce(F.max("rows_seen"), F.lit(0)).alias("b"))
    update = update.join(F.broadcast(before), F.lit(True)).select("shard", "cursor", (F.col("rows_seen") + F.col("b")).alias("rows_seen"), "completed")
    return merge_upsert(state, update, ["shard"])


def reset(state: DataFrame, shard: str | None = None) -> DataFrame:
    """The ingest state without a shard, or without all."""
    return state.limit(0) if shard is None else state.where(F.col("shard") != shard)

"""Star events as streams: deduplication under a watermark, windowed velocity, sessions, upserting sink."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def star_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The star events below ``path`` as a stream; ``at`` is the time at which a row came in."""
    schema = "actor string, repo_id bigint, starred_at date, ingested_at timestamp_ntz"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("at", F.col("ingested_at").cast("timestamp"))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """Each key once within the watermark; state older than that is let go."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def velocity(rows: DataFrame, key: str, length: str = "90 days", step: str | None = None, late: str = "1 day") -> DataFrame:
    """Events per key and window (sliding if ``step`` is given); rows later than the watermark don't count."""
    window = F.window("at", length, step) if step else F.window("at", length)
    counted = rows.withWatermark("at", late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(rows: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events per key and session."""
    counted = rows.withWatermark("at", late).groupBy(F.session_window("at", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def running_totals(rows: DataFrame, key: str) -> DataFrame:
    """A custom stateful operator: running count and value sum per key, emitted on each change."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def upserting(path: str, keys: list[str], ignore: bool = False, order: list[str] | None = None, most_parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch adds a part with one row for each of its keys; a batch that comes again changes nothing.

    A batch writes its own rows only. The table is read by ``upserted``: of a key's parts the last counts, or with ``ignore``
    the first. Of a batch's rows of a key the last by ``order`` (else by all other columns) counts, or with ``ignore`` the first.
    Every ``most_parts`` batches what is there is written as a base, and the parts before it go once the base after it is written.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{path}/part/{number:010d}"
        if _there(spark, f"{done}/_SUCCESS") or _base(spark, path) >= number:
            return
        rest = [c for c in batch.columns if c not in keys]
        pick = F.min_by if ignore else F.max_by
        one = batch.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*(order or rest))).alias("s")).select(*keys, "s.*") if rest else batch.select(*keys).distinct()
        one.select(batch.columns).write.mode("overwrite").parquet(done)
        if number and number % most_parts == 0:
            last = _base(spark, path)
            upserted(spark, path, keys, ignore).write.mode("overwrite").parquet(f"{path}/base/{number:010d}")
            for folder, name in _names(spark, path):  # what the base before this one stood for has no reader left
                if int(name) <= last and (folder, int(name)) != ("base", last):
                    _remove(spark, f"{path}/{folder}/{name}")

    return sink


def upserted(spark: SparkSession, path: str, keys: list[str], ignore: bool = False) -> DataFrame:
    """The table that ``upserting`` wrote: its last base and the parts after it, each key once."""
    base = _base(spark, path)
    names = [(folder, name) for folder, name in _names(spark, path) if (folder == "base" and int(name) == base) or (folder == "part" and int(name) > base)]
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{folder}/{name}").withColumn("__part", F.lit(int(name))) for folder, name in names])
    rest = [c for c in rows.columns if c not in (*keys, "__part")]
    if not rest:
        return rows.select(*keys).distinct()
    pick = F.min_by if ignore else F.max_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), "__part").alias("s")).select(*keys, "s.*")


def _files(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def _there(spark: SparkSession, path: str) -> bool:
    fs, name = _files(spark, path)
    return fs.exists(name)


def _remove(spark: SparkSession, path: str) -> None:
    fs, name = _files(spark, path)
    fs.delete(name, True)


def _names(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(folder, name)`` of the bases and parts that are whole."""
    found = []
    for folder in ("base", "part"):
        fs, name = _files(spark, f"{path}/{folder}")
        there = [e.getPath().getName() for e in fs.listStatus(name)] if fs.exists(name) else []
        found += [(folder, n) for n in sorted(there) if _there(spark, f"{path}/{folder}/{n}/_SUCCESS")]
    return found


def _base(spark: SparkSession, path: str) -> int:
    """The number of the last whole base, -1 if there is none."""
    return max((int(n) for folder, n in _names(spark, path) if folder == "base"), default=-1)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there into a table in memory, for tests and reports on bounded input."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query: StreamingQuery = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

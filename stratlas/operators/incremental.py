"""Processing only new or changed records (problem 4): versioned key and content-hash state.

The state is a row of parts, each a Parquet folder of ``(key, as_of, tie, hash)``: a base and the changes of later runs, of
which the last one counts for a key. A run writes its changes only, once; when the changes outgrow the base, or
are many, the next run writes a new base. The manifest ``versions/<n>`` names the parts of a version and is put in
place by one rename that fails where that version is there already. A run that dies before the rename leaves the
old version in force, so its records are taken up again by the next; of two runs at once one fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratlas.session import materialise, work_path

MOST_PARTS = 12  # changes beside a base


def content_hash(*columns: str) -> Column:
    """A hash of the columns' contents in which null differs from every string and fields don't run together."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


class Overtaken(RuntimeError):
    """Another run has put this version in place."""


@dataclass
class Manifest:
    """A version of the state: the horizon up to which landings were seen, its parts in their order, and their rows."""

    version: int = 0
    horizon: str | None = None
    parts: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


@dataclass
class Take:
    """What a run took up, and the manifest that its commit will put in place."""

    manifest: Manifest
    rows: DataFrame

    @property
    def version(self) -> int:
        return self.manifest.version


class StateStore:
    """Versions of ``(key, as_of, tie, hash)`` in a folder of any Hadoop file system."""

    SCHEMA = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("as_of", T.TimestampNTZType()), T.StructField("tie", T.LongType()), T.StructField("hash", T.StringType())]
    )
    CHANGES = T.StructType([*SCHEMA.fields, T.StructField("changed", T.BooleanType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(self.path).getFileSystem(self._conf)

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or of the one in force (version 0: none yet)."""
        folder = self._Path(f"{self.path}/versions")
        if version is None:
            there = self._fs.listStatus(folder) if self._fs.exists(folder) else []
            version = max([int(name) for x in there if (name := x.getPath().getName()).isdigit()], default=0)
        if version == 0:
            return Manifest()
        opened = self._fs.open(self._Path(folder, f"{version:010d}"))
        try:
            return Manifest(**json.loads(bytes(opened.readAllBytes()).decode()))
        finally:
            opened.close()

    def current(self) -> tuple[int, str | None]:
        """The version in force and its horizon."""
        now = self.manifest()
        return now.version, now.horizon

    def read(self, manifest: Manifest, keys: DataFrame | None = None) -> DataFrame:
        """The state of a version, of all keys or of those in ``keys``: cut down to these before it is grouped."""
        parts = [self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{part}").withColumn("part", F.lit(number)) for number, part in enumerate(manifest.parts)]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            rows = rows.join(keys, "key", "left_semi")
        last = rows.groupBy("key").agg(F.max_by(F.struct("as_of", "tie", "hash"), "part").alias("s"))
        return last.select("key", "s.as_of", "s.tie", "s.hash")

    def swap(self, take: Take, horizon: str) -> None:
        """Put what a run took up in force; ``Overtaken`` if another run has been faster."""
        new = take.manifest
        new.horizon = horizon
        staged, final = self._Path(f"{self.path}/staged/{uuid.uuid4().hex}"), self._Path(f"{self.path}/versions/{new.version:010d}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(vars(new)).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(staged, final, options)  # it fails where the version is there
        except Exception as failure:
            self._fs.delete(staged, True)
            if self._fs.exists(final):
                raise Overtaken(f"version {new.version} of {self.path} is there already") from failure
            raise

    def vacuum(self) -> None:
        """Remove the parts that neither the version in force nor the one before it names: old bases, and runs that died.

        No run may be under way.
        """
        now = self.manifest()
        named = {*now.parts, *(self.manifest(now.version - 1).parts if now.version > 1 else [])}
        for folder in ("base", "changes", "staged"):
            at = self._Path(f"{self.path}/{folder}")
            for entry in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f"{folder}/{entry.getPath().getName()}" not in named:
                    self._fs.delete(entry.getPath(), True)


def run_once(
    store: StateStore,
    landings: DataFrame,
    upto: str,
    key: str = "repo_id",
    content: tuple[str, ...] = ("embedding_input", "readme_raw"),
    taken_at: str = "fetched_at",
    landed_at: str = "landed_at",
    tie: str = "fetch_id",
) -> Take:
    """Take up the keys whose content is new or changed among rows landed up to ``upto`` (inclusive).

    Only rows landed since the state's horizon are read (a pushed-down range), and of these the latest per key
    by ``taken_at`` (ties by the larger ``tie``) is hashed and joined with the state of these keys. A row older than the
    state of its key changes nothing, however late it lands; a row delivered again neither. Null content is a value; a
    null key or ``landed_at`` is no landing; a null ``taken_at`` is older than any other. The caller commits with
    ``store.swap(take, upto)`` once it has processed ``take.rows`` (``key``, ``as_of``, ``tie``, ``hash``), whose landings
    ``records`` gives.
    """
    before = store.manifest()
    hashed = hashed_landings(landings, upto, before.horizon, key, content, taken_at, landed_at, tie)
    floor = F.lit("0001-01-01").cast("timestamp_ntz")
    order = F.struct(F.coalesce("as_of", floor).alias("at"), "tie", "hash")
    latest = hashed.groupBy("key").agg(F.max_by(F.struct("as_of", "tie", "hash"), order).alias("new"))
    if before.parts:  # used twice
        latest = materialise(latest, "incremental-latest")
    rank = lambda at, n: F.struct(F.coalesce(at, floor).alias("at"), F.coalesce(n, F.lit(-(2**63))).alias("tie"))
    if before.parts:
        old = store.read(before, latest.select("key")).select("key", F.col("as_of").alias("old_as_of"), F.col("tie").alias("old_tie"), F.col("hash").alias("old_hash"))
        both = latest.join(old, "key", "left").where(F.col("old_hash").isNull() | (rank("new.as_of", "new.tie") >= rank("old_as_of", "old_tie")))
    else:
        both = latest.withColumn("old_hash", F.lit(None).cast("string")).withColumn("old_as_of", F.lit(None).cast("timestamp_ntz")).withColumn("old_tie", F.lit(None).cast("long"))
    changed = ~F.col("new.hash").eqNullSafe(F.col("old_hash"))
    moved = changed | ~F.col("new.as_of").eqNullSafe(F.col("old_as_of")) | ~F.col("new.tie").eqNullSafe(F.col("old_tie"))
    part = f"changes/{before.version + 1:010d}-{uuid.uuid4().hex}"
    both.where(moved).select("key", "new.as_of", "new.tie", "new.hash", changed.alias("changed")).write.parquet(f"{store.path}/{part}")
    done = store.spark.read.schema(store.CHANGES).parquet(f"{store.path}/{part}")  # one write gives both the state and the rows to process
    after = Manifest(before.version + 1, None, [*before.parts, part], [*before.sizes, done.count()])
    if len(after.parts) > MOST_PARTS or (len(after.parts) > 2 and sum(after.sizes[1:]) > after.sizes[0]):
        base = f"base/{after.version:010d}-{uuid.uuid4().hex}"
        store.read(after).write.parquet(f"{store.path}/{base}")
        after = Manifest(after.version, None, [base], [store.spark.read.parquet(f"{store.path}/{base}").count()])
    return Take(after, done.where("changed").select("key", "as_of", "tie", "hash"))


def hashed_landings(landings: DataFrame, upto: str, since: str | None, key: str, content: tuple[str, ...], taken_at: str, landed_at: str, tie: str) -> DataFrame:
    """``(key, as_of, tie, hash)`` of the rows landed after ``since`` and up to ``upto``: texts are hashed in the scan and never shuffled."""
    rows = landings.where(F.col(landed_at) <= F.lit(upto).cast("timestamp_ntz")).where(F.col(key).isNotNull())
    if since:
        rows = rows.where(F.col(landed_at) > F.lit(since).cast("timestamp_ntz"))
    return rows.select(
        F.col(key).cast("long").alias("key"), F.col(taken_at).cast("timestamp_ntz").alias("as_of"), F.col(tie).cast("long").alias("tie"),
        content_hash(*content).alias("hash"),
    )


def records(landings: DataFrame, take: Take, key: str = "repo_id", content: tuple[str, ...] = ("embedding_input", "readme_raw"), tie: str = "fetch_id") -> DataFrame:
    """The landings that a run took up, whole, one for each key: those of the taken key, tie and content.

    A row delivered several times comes once, as the one of its key that is first by its other columns.
    """
    chosen = take.rows.select(F.col("key").alias(key), F.col("tie").alias(tie), F.col("hash").alias("taken_hash"))
    rows = landings.withColumn("taken_hash", content_hash(*content)).join(chosen, [key, tie, "taken_hash"], "left_semi")
    rest = [c for c in landings.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in landings.columns])


def replay(landings: DataFrame, runs: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """``(run_id, repo_id)``: what each run with status ``ok`` takes up, in the order of ``started_at``.

    ``runs`` is a control table (``run_id, started_at, status``); its ok rows are collected. Runs with another or
    null status, or no ``started_at``, take up nothing and leave the state as it is.
    """
    spark = landings.sparkSession
    store = StateStore(spark, path or work_path(spark, "incremental"))
    ok = runs.where("status = 'ok' and started_at is not null").select("run_id", F.col("started_at").cast("string").alias("at"))
    out = None
    for run in ok.orderBy("at", "run_id").collect():
        take = run_once(store, landings, run["at"], **columns)
        store.swap(take, run["at"])
        rows = take.rows.select(F.lit(run["run_id"]).cast("long").alias("run_id"), F.col("key").alias("repo_id"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "run_id long, repo_id long") if out is None else out

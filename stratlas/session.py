"""Session helpers: a local builder, table access and the shared working folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the given session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stratlas")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they needn't have it installed.

    The archive lies in the shared folder, from which every executor, later ones too, fetches it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{shared_dir(spark).rstrip('/')}/stratlas/{uuid.uuid4().hex}/stratlas.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(raw.getvalue()))
    out.close()
    context.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession) -> None:
    """Remove what this package wrote to the shared folder; results read from there end with it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/stratlas")
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and all runs in this machine's
    one process, as in tests, is a folder of our own made. Executors elsewhere couldn't read such a folder, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"stratlas-{os.getpid()}")
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/stratlas/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done.work_path = path
    return done


def release(df: DataFrame) -> None:
    """Remove what ``materialise`` wrote for ``df``, once nothing reads it any more; other data frames are left alone."""
    path = getattr(df, "work_path", None)
    if path:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

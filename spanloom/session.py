"""Session helpers: settings and the shared staging folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "spanloom") -> SparkSession:
    """A session with adaptive execution on; sizes are left to the cluster unless given."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; on a cluster that is an error,
    since each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_staged: list[str] = []  # paths this process handed out


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; see ``remove_staged``."""
    _staged.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _staged[-1]


def remove_staged(spark: SparkSession) -> int:
    """Delete what this process staged, once no result that reads it is needed any more; returns how many paths."""
    files, configuration = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    removed = 0
    while _staged:
        path = files.Path(_staged.pop())
        removed += path.getFileSystem(configuration).delete(path, True)
    return removed


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside remove their shuffle files when they end; else these stay until garbage happens to be collected."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executor loss."""
    path = staging_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors' Python workers, where it is not installed; returns the archive's path.

    Functions that run in workers are looked up by name there, so workers must be able to import the package.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if not name.endswith(".pyc"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("spanloom", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)  # Spark serves it to all executors
    return archive

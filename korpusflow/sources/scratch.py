"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a local session gets one of its own and any other uses its warehouse."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        at = tempfile.mkdtemp(prefix="korpusflow-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
        return at
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_korpusflow"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def session_folder(spark: SparkSession) -> str:
    """A folder for this application, removed when Python ends, unless the session has ended before."""
    path = f"{shared_folder(spark)}/korpusflow-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)

        def clear() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone
                remove(spark, path)

        atexit.register(clear)
    return path


_FOLDERS: set[str] = set()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes the files of its shuffles when it ends, not only when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written as Parquet in the shared folder (in a folder for each value of `by`) and read from there: its lineage ends, its rows can't change."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame, part: str = "") -> None:
    """Deletes what stored() wrote, or one of its folders; nothing may read it any more."""
    for df in frames:
        remove(df.sparkSession, f"{df.stored_at}/{part}" if part else df.stored_at)

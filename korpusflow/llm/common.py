"""What several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder and any
    other session uses the warehouse, which executors share too.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        at = tempfile.mkdtemp(prefix="korpusflow-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
        return at
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_korpusflow"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as Parquet in the shared folder, in a folder for each value of `by`, and returns it as read from there: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote; nothing may read it any more."""
    for df in frames:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of stages that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns what this worker has freed to the system, so that the next stage's memory isn't counted on top of it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of these has."""
    while any(name in df.columns for df in frames):
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def batches_of(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows into parts of about so many bytes, so that Python objects stay few."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(n, n * most_bytes // max(1, batch.get_total_buffer_size())))
    for at in range(0, n, step):
        yield batch.slice(at, step)

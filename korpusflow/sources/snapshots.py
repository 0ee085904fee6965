"""Snapshots of several tables that readers see whole: each is written aside, and a manifest that names it comes last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korpusflow.sources.scratch import shuffles_removed

_MANIFESTS, _END = "_manifests", "complete"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the manifests that are whole, the newest first."""
    fs, at = _fs(spark, f"{path}/{_MANIFESTS}")
    if not fs.exists(at):
        return []
    out = []
    for f in fs.listStatus(at):
        stream = fs.open(f.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        number, _, version = f.getPath().getName().partition("-")
        if text == f"{version} {_END}" and number.isdigit():
            out.append((int(number), version))
    return sorted(out, reverse=True)


def version_at(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest whole version, or None."""
    found = _manifests(spark, path)
    return f"{path}/{found[0][1]}" if found else None


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame | list[DataFrame] | Callable[[str], DataFrame]], by: dict[str, tuple[str, ...]] | None = None) -> str:
    """Writes the tables as a new version and then its manifest; `by`: columns that a table's folders are named after.  A table may be a function of the version's folder, where those before it are, or a list of parts that are written one after the other.

    Until the manifest is there readers get the version before, and so they do
    for good if the writer is killed.  That one is kept for readers that have begun; older ones are deleted.
    """
    before = _manifests(spark, path)
    version = uuid.uuid4().hex
    for name, df in tables.items():
        parts = df if isinstance(df, list) else [df if isinstance(df, DataFrame) else df(f"{path}/{version}")]
        for part in parts:
            with shuffles_removed(spark):
                part.write.mode("append").option("compression", "zstd").partitionBy(*(by or {}).get(name, ())).parquet(f"{path}/{version}/{name}")
    number = before[0][0] + 1 if before else 1
    fs, at = _fs(spark, f"{path}/{_MANIFESTS}/{number:012d}-{version}")
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(f"{version} {_END}".encode()))
    finally:
        stream.close()
    for old, gone in before[1:]:
        fs.delete(_fs(spark, f"{path}/{_MANIFESTS}/{old:012d}-{gone}")[1], False)
        fs.delete(_fs(spark, f"{path}/{gone}")[1], True)
    return f"{path}/{version}"

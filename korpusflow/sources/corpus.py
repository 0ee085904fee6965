"""Corpora: folders of text files, tables, streams of files; token tables; snapshots."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions.arrow import counted, pieces, token_array
from korpusflow.functions.text import tokens
from korpusflow.sources import snapshots
from korpusflow.sources.scratch import stored


def cut(df: DataFrame) -> DataFrame:
    """Ends a lineage by a checkpoint in the shared folder of spark.checkpoint.dir; a local session without one gets its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
            at = tempfile.mkdtemp(prefix="korpusflow-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name), text: each regular file of a folder, not of its subfolders."""
    read = spark.read.option("recursiveFileLookup", "false").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    # Spark's file sources leave out empty files, but they are documents too: they count in totals and average length
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    empty = [(f.getPath().getName(), "") for f in found if f.isFile() and f.getLen() == 0]
    return read.unionByName(spark.createDataFrame(empty, "doc_id string, text string")) if empty else read


def table_corpus(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out anew, row by row; one of more stays as it is."""
    sc = df.sparkSession.sparkContext
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(sc.defaultParallelism) if splits < sc.defaultParallelism else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once for a row.

    A projection would be merged into what reads it, and each use would compute it again; a generator of one row isn't.
    """
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*df.columns, F.inline(F.array(made)))


def token_rows(corpus: DataFrame) -> DataFrame:
    """doc_id, w: each row's tokens."""
    text = corpus.select("doc_id", "text")
    return once(text, w=tokens(F.col("text"))).select("doc_id", "w")


def rows_of(corpus: DataFrame) -> DataFrame:
    """row, doc_id, w (tokens), stored: a row's key can't change, and ids may be null or repeat."""
    return cut(corpus.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens(F.col("text")).alias("w")))


def token_table(corpus: DataFrame) -> DataFrame:
    """doc_id, at (0-based), surface: a narrow step; the text itself doesn't travel with its tokens."""
    return corpus.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("at", "surface"))


def repeated(corpus: DataFrame) -> DataFrame:
    """__id: the ids, null too, that more than one row has; stored."""
    return stored(corpus.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__id"), "repeated-ids")


def surface_counts(corpus: DataFrame) -> DataFrame:
    """doc_id, surface, n: a row for each surface of each row of the corpus; its tokens don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            row, words, n = counted(*token_array(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), words, pa.array(n)], ["doc_id", "surface", "n"])

    return corpus.select("doc_id", "text").mapInArrow(run, f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, surface string, n long")


def lengths(corpus: DataFrame) -> DataFrame:
    """doc_id, n_tokens: every document, empty ones too."""
    return corpus.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def totals(corpus: DataFrame) -> DataFrame:
    """One row: total_words, total_files."""
    return lengths(corpus).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total_words"), F.count(F.lit(1)).alias("total_files"))


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table of a snapshot, of its newest whole version; or a plain message if there is none.  What else may be wrong with it stays an error of its own.

    A single table that save() wrote counts as whole when its writer has marked it so.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    at = snapshots.version_at(spark, folder) if folder else None
    if at and snapshots.exists(spark, f"{at}/{name}"):
        return spark.read.parquet(f"{at}/{name}")
    if not snapshots.exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no snapshot at {path}; build it first")
    return spark.read.parquet(path)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    try:
        return load(spark, path)
    except FileNotFoundError:
        save(build(), path)
        return load(spark, path)

"""Frequency lists over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.operators.morphology import Dictionary, annotated

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New Parquet files of a folder as they arrive: doc_id, text."""
    return spark.readStream.schema(schema).parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def running_frequency(corpus: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """lemma, pos, occ so far: for output mode 'update' or 'complete'; the state holds a number for each lemma."""
    return annotated(corpus, dictionary).groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("occ"))

"""Words that no form of the dictionary has, as lexemes that are kept from corpus to corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korpusflow.functions.text import deyotized
from korpusflow.operators.morphology import Dictionary, unknown_id
from korpusflow.sources import snapshots
from korpusflow.sources.corpus import once, token_rows
from korpusflow.sources.scratch import stored

SCHEMA = "surface string, lexeme_id long, occ long, texts long"
TABLE = "unknown"


def counts(corpus: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """surface, occ, texts of the corpus's unknown words; a row is a text, whatever its id.

    A row's own words are sorted, so that the first of equal ones counts the text: one shuffle is left, of sums.
    """
    rows = once(token_rows(corpus.select(F.lit(0).alias("doc_id"), "text")), sorted=F.array_sort("w"))
    words = F.transform("sorted", lambda x, k: F.struct(x.alias("surface"), F.coalesce(F.get(F.col("sorted"), k - 1) != x, F.lit(True)).cast("long").alias("first")))
    out = rows.select(F.inline(words)).groupBy("surface").agg(F.count(F.lit(1)).alias("occ"), F.sum("first").alias("texts"))
    return out if dictionary is None else out.join(dictionary.resolution().select("surface"), "surface", "left_anti")


def merged(known: DataFrame | None, found: DataFrame, bits: int = 62) -> DataFrame:
    """surface, lexeme_id, occ, texts: counts are summed, ids that are known stay, new words get ids that nobody has.

    An id is below -1 and comes from the word's hash (`bits` of it).  Of new words with
    one id, or with a known one, all but the first take the hash of the word and
    the number of the round, until no two words share an id.
    """
    spark = found.sparkSession
    known = spark.createDataFrame([], SCHEMA) if known is None else known
    every = known.withColumn("old", F.lit(True)).unionByName(found.select("surface", F.lit(None).cast("long").alias("lexeme_id"), "occ", "texts", F.lit(False).alias("old")))
    every = every.groupBy("surface").agg(F.max("lexeme_id").alias("lexeme_id"), F.sum("occ").alias("occ"), F.sum("texts").alias("texts"), F.max("old").alias("old"))
    own = -2 - F.shiftrightunsigned(-2 - unknown_id(F.col("surface")), 62 - bits)
    every = stored(every.withColumn("lexeme_id", F.coalesce("lexeme_id", own)), "unknown")
    first, tries = F.row_number().over(Window.partitionBy("lexeme_id").orderBy(F.desc("old"), "surface")), 0
    while every.groupBy("lexeme_id").count().where("count > 1").limit(1).count():
        tries += 1
        again = -2 - F.shiftrightunsigned(F.xxhash64("surface", F.lit(tries)), 2 + max(0, 62 - bits - tries))
        # who has kept an id keeps it, so that each round only places those that are left
        every = stored(every.withColumn("k", first).select("surface", F.when(F.col("k") == 1, F.col("lexeme_id")).otherwise(again).alias("lexeme_id"), "occ", "texts", (F.col("k") == 1).alias("old")), "unknown")
    return every.select("surface", "lexeme_id", "occ", "texts")


def aliases(unknown: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """alias, surface, lexeme_id: a spelling with е that is no word itself stands for the first unknown word with ё that is spelt so."""
    rows = unknown.where(F.col("surface").rlike("[ёЁ]")).select(deyotized(F.col("surface")).alias("alias"), "surface", "lexeme_id")
    rows = rows.join(unknown.select(F.col("surface").alias("alias")), "alias", "left_anti")
    if dictionary is not None:
        rows = rows.join(dictionary.resolution().select(F.col("surface").alias("alias")), "alias", "left_anti")
    return rows.groupBy("alias").agg(F.min(F.struct("surface", "lexeme_id")).alias("to")).select("alias", "to.surface", "to.lexeme_id")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The unknown words of the newest whole version, or None."""
    at = snapshots.version_at(spark, path)
    return spark.read.parquet(f"{at}/{TABLE}") if at else None


def grow(path: str, corpus: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Adds a corpus to the unknown words at `path` as a new version: a writer that is killed leaves the one before; a corpus that is added twice counts twice."""
    spark = corpus.sparkSession
    at = snapshots.publish(spark, path, {TABLE: merged(load(spark, path), counts(corpus, dictionary))})
    return spark.read.parquet(f"{at}/{TABLE}")

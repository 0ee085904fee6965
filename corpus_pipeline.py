"""The documents' way to training windows: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.llm.common import release, stored
from korpusflow.llm.exact_dedup import exact_dedup
from korpusflow.llm.near import near_copies
from korpusflow.llm.packing import pack
from korpusflow.llm.quality_model import quality_classifier
from korpusflow.llm.quality_rules import quality_rules
from korpusflow.llm.simhash import simhash_groups

#: The key of a row; a stage's own, never returned.
ROW = "__row"


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is 0.5 or more stay, each judged by its own text, whatever its id; a null or empty text by the scorer's constant."""
    return quality_classifier(docs).where("kept").select(docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay that the base rule passes and that are more probably good than bad; null, empty and very short texts go."""
    return quality_rules(docs).where("kept").select(docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, stored, so that it can't change: ids may be null or repeat."""
    release(docs.sparkSession)
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (a null id only if there is no other, then the largest row key); null texts equal empty ones.

    Decided for each row by its own key: ids may be null or repeat.  Digests are
    taken while the texts are read, so that no text is shuffled for the decision;
    only the keys of the copies are joined back.
    """
    rows = keyed(docs)
    copies = exact_dedup(rows.select(F.struct("doc_id", ROW).alias("id"), "text"), "id", digest_col="sha").where("not kept").select(f"id.{ROW}")
    return rows.join(copies, ROW, "left_anti").select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays, by chains of two kinds of links: SimHash fingerprints that differ in 3 bits at most (op4), and five-word Jaccard similarity of 0.8 or more.

    Fingerprints miss most pairs of that similarity, so both are looked for among all rows, and groups are joined by either.
    Texts without words have fingerprint 0 and are a group.
    """
    rows = keyed(docs)
    alike = simhash_groups(rows, ROW).where(f"component_id != {ROW}").select(F.col(ROW).alias("u"), F.col("component_id").alias("v"))
    return rows.join(near_copies(rows, more=alike), ROW, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows to train on: every row's ids, cut into pieces with their places in sequences of at most 2048; null texts are empty, an empty table gives none."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage.  Each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Ranks of a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.sources.scratch import stored

_AT = (1 << 33) - 1  # a row's place in its partition, in monotonically_increasing_id


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df and each row's place (from 1) in this order; rows that the order doesn't tell apart get places in any order.

    The rows go to ranges of the order and are sorted there; how many rows the
    ranges before it hold is a range's offset.  Only these counts, one for each
    range, reach the driver.  The order should tell rows apart: ranges are cut
    by all of it, so a first column that is the same everywhere makes no task
    larger.  An empty table gives none.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = stored(placed.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_AT)).alias("__at")), "ranked")
    before, offsets = 0, []
    for r in rows.groupBy("__range").count().orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r["count"]
    first = spark.createDataFrame(offsets, "__range int, __before long")
    return rows.join(F.broadcast(first), "__range").select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias(name))

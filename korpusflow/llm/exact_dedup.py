"""Exact dedup by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import ascii_lower, fresh

#: Characters that the second level hashes.
PREFIX = 64
RESULTS = ("keep_id", "group_size", "kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = PREFIX, digest_col: str | None = None) -> DataFrame:
    """Adds keep_id, group_size and kept to every row.

    Texts are equal if identical after lower-casing A-Z; of equal texts the row
    with the largest id stays.  Three levels, each for what the one before left
    undecided: rows that share their length; of those, rows that share the hash
    of their first `prefix` characters; of those, rows that share the SHA-256
    of the whole text.  Only counts for each length, prefix and digest are
    gathered, summed before they are shuffled, so a group of any size costs no
    more than its partial counts; the joins back are left joins on these sums,
    which AQE splits or broadcasts by their measured size.

    digest_col: also return the lower-case hex SHA-256 of each normalised text;
    this hashes the undecided rows too.

    Null texts equal empty ones.  Rows that repeat an id count in group_size
    each and share their fate: kept is true on every row whose id is the
    group's largest.  A null id stays only if its group has no other.
    """
    length, head, sha, opened, n, largest, size = (fresh(f"__{x}", docs) for x in ("length", "prefix", "sha", "open", "n", "keep", "size"))
    base = docs.drop(*RESULTS, *([digest_col] if digest_col else []))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base.withColumn(length, F.octet_length(text)).withColumn(head, F.xxhash64(ascii_lower(F.substring(text, 1, prefix))))
    whole = F.sha2(ascii_lower(text), 256)
    if digest_col:
        base = base.withColumn(digest_col, whole)
    # the counts by length come from those by length and prefix: no row is dealt by its length alone
    both = base.groupBy(length, head).agg(F.count(F.lit(1)).alias(n))
    lengths = both.groupBy(length).agg(F.sum(n).alias(n)).where(F.col(n) > 1).select(length)
    prefixes = both.where(F.col(n) > 1).join(lengths, length, "left_semi").select(length, head, F.lit(True).alias(opened))
    full = base.join(prefixes, [length, head], "left").withColumn(sha, F.when(F.col(opened), F.col(digest_col) if digest_col else whole))
    groups = full.where(F.col(sha).isNotNull()).groupBy(sha).agg(F.max(id_col).alias(largest), F.count(F.lit(1)).alias(size)).where(F.col(size) > 1)
    # decided rows have no digest; a key of their own each keeps them from meeting in one task
    alone = F.concat(F.lit("-"), F.xxhash64(id_col, length, head).cast("string"))
    out = full.withColumn(sha, F.coalesce(sha, alone)).join(groups, sha, "left").withColumn("keep_id", F.when(F.col(size).isNull(), F.col(id_col)).otherwise(F.col(largest)))
    out = out.withColumn("group_size", F.coalesce(size, F.lit(1).cast("long"))).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return out.drop(length, head, opened, sha, largest, size)

"""Frequency lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.operators.morphology import UNKNOWN, Dictionary, annotate, is_function_word
from korpusflow.sources.corpus import repeated, surface_counts
from korpusflow.sources.resources import POS_ORDER

known: Callable[[Column], Column] = lambda pos: pos != UNKNOWN
unknown: Callable[[Column], Column] = lambda pos: pos == UNKNOWN
content: Callable[[Column], Column] = lambda pos: (pos != UNKNOWN) & ~is_function_word(pos)


def _by_document(corpus: DataFrame, dictionary: Dictionary | None, lexeme: list[str], where: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """lexeme, doc_id, n, each lexeme and document once, in two parts: what a row alone decides, and what is added up (None: nothing)."""
    again = repeated(corpus)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    some = not again.isEmpty()

    def rows(part: DataFrame) -> DataFrame:
        out = annotate(surface_counts(part), dictionary)
        return out if where is None else out.where(where(F.col("pos")))

    alone, parts = rows(corpus.join(again, same, "left_anti") if some else corpus), []
    if dictionary is not None:
        parts.append(alone.where(F.col("pos") != UNKNOWN))
        alone = alone.where(F.col("pos") == UNKNOWN)
    if some:
        parts.append(rows(corpus.join(again, same, "left_semi")))
    added = reduce(DataFrame.unionByName, parts).groupBy(*lexeme, "doc_id").agg(F.sum("n").alias("n")) if parts else None
    return alone.select(*lexeme, "doc_id", "n"), added


def frequency_list(corpus: DataFrame, dictionary: Dictionary | None = None, where: Callable[[Column], Column] | None = None, ordered: bool = True, ids: bool = False) -> DataFrame:
    """lemma, pos, occ, ipm (per million tokens of the whole corpus), texts: a row for each lexeme, with its lexeme_id if `ids`.

    Two lexemes of one lemma and part of speech are two rows.  Surfaces are
    counted within their row first.  An unknown surface is all that its lexeme
    has in a document, so its counts are summed at once; only those of
    known lexemes and of ids that repeat are shuffled by document.  The filter stands before the counting.
    """
    lexeme = ["lemma", "pos"] if dictionary is None and not ids else ["lexeme_id", "lemma", "pos"]
    words = surface_counts(corpus).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    single, others = _by_document(corpus, dictionary, lexeme, where)
    out = single.groupBy(*lexeme).agg(F.sum("n").alias("occ"), F.count(F.lit(1)).alias("texts"))
    if others is not None:
        more = others.groupBy(*lexeme).agg(F.sum("n").alias("occ"), F.count(F.lit(1)).alias("texts"))
        out = out.unionByName(more).groupBy(*lexeme).agg(F.sum("occ").alias("occ"), F.sum("texts").alias("texts"))
    out = out.select(*lexeme, "occ", F.round(F.col("occ") * 1e6 / F.lit(max(words, 1)), 6).alias("ipm"), "texts")
    rank = F.array_position(F.array(*map(F.lit, POS_ORDER)), F.col("pos"))
    out = out.orderBy(F.desc("occ"), "lemma", rank) if ordered else out
    return out if ids else out.select("lemma", "pos", "occ", "ipm", "texts")


def postings(corpus: DataFrame, dictionary: Dictionary | None = None, ids: bool = False) -> DataFrame:
    """lemma, doc_id, tf: a row for each lexeme and document, with the lexeme_id if `ids`."""
    lexeme = ["lemma"] if dictionary is None and not ids else ["lexeme_id", "lemma"]
    single, others = _by_document(corpus, dictionary, lexeme)
    out = (single if others is None else single.unionByName(others)).withColumnRenamed("n", "tf")
    return out if ids else out.select("lemma", "doc_id", "tf")

"""BM25 search with thesaurus expansion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.text import tokens
from korpusflow.operators.morphology import Dictionary, resolve_entries, resolve_words, surfaces_of
from korpusflow.sources.corpus import once, token_rows
from korpusflow.sources.resources import FUNCTION_POS

K1, B = 2.0, 0.75


def query_lexemes(corpus: DataFrame, query: str, dictionary: Dictionary | None = None, thesaurus: DataFrame | None = None) -> list[tuple[int, str]]:
    """Distinct lexemes (id, lemma) of the query without function words (by the form), and their synonyms one step down."""
    spark = corpus.sparkSession
    words = spark.range(1).select(tokens(F.lit(query)).alias("w")).first()["w"]
    lexemes = {(r["lexeme_id"], r["lemma"]) for r in resolve_words(spark, words, dictionary) if r["form_pos"] not in FUNCTION_POS} if words else set()
    if thesaurus is not None and lexemes:
        entries = thesaurus.select(F.col("head").alias("entry")).unionByName(thesaurus.select(F.col("synonym").alias("entry")))
        found = resolve_entries(entries, dictionary)
        heads = found.where(F.col("lexeme_id").isin(*(i for i, _ in lexemes))).select(F.col("entry").alias("head"), F.col("lemma").alias("own"), F.col("lexeme_id").alias("head_id"))
        rows = thesaurus.join(heads, "head").join(found.select(F.col("entry").alias("synonym"), "lexeme_id", "lemma"), "synonym")
        lexemes |= {(r.lexeme_id, r.lemma) for r in rows.select("head_id", "own", "lexeme_id", "lemma").distinct().collect() if (r.head_id, r.own) in lexemes}
    return sorted(lexemes)


def query_terms(corpus: DataFrame, query: str, dictionary: Dictionary | None = None, thesaurus: DataFrame | None = None) -> list[str]:
    return sorted({lemma for _, lemma in query_lexemes(corpus, query, dictionary, thesaurus)})


def _count(own: list[str]) -> Column:
    return F.size(F.filter("hits", lambda x: x.isin(*own)))


def bm25(corpus: DataFrame, query: str, dictionary: Dictionary | None = None, thesaurus: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """doc_id, score > 0, best first.  idf isn't floored: a lexeme in more than half of the documents subtracts.

    A row is a document, whatever its id.  A lexeme is counted where one of its
    surfaces stands, in the row's own tokens: the first pass sums lengths and
    document frequencies, the second scores; nothing is joined or shuffled but
    these sums and the sorted result.
    """
    spark = corpus.sparkSession
    lexemes = query_lexemes(corpus, query, dictionary, thesaurus)
    surfaces = surfaces_of(spark, lexemes, dictionary)
    every = sorted({x for own in surfaces for x in own})
    rows = token_rows(corpus)
    hits = F.filter("w", lambda x: x.isin(*every)) if every else F.slice("w", 1, 0)
    rows = once(rows, n=F.size("w"), hits=hits).select("doc_id", "n", "hits")
    rows = rows.select("doc_id", "n", *(_count(own).alias(f"tf{j}") for j, own in enumerate(surfaces)))
    first = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), *(F.count(F.when(F.col(f"tf{j}") > 0, 1)) for j in range(len(lexemes)))).first()
    n, average = first[0], first[1] / first[0] if first[0] and first[1] else 1.0
    score = F.lit(0.0)
    for j, df in enumerate(first[2:]):
        tf = F.col(f"tf{j}")
        score = score + F.lit(math.log((n - df + 0.5) / (df + 0.5))) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(average))))
    out = rows.select("doc_id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id")
    return out.limit(k) if k else out

"""Concordances of a lemma phrase."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.text import tokens
from korpusflow.operators.morphology import Dictionary, annotate, resolve_words, surfaces_of
from korpusflow.sources.corpus import once, token_rows
from korpusflow.sources.scratch import stored


def phrase_lexemes(corpus: DataFrame, phrase: str, dictionary: Dictionary | None) -> list[tuple[int, str]]:
    """The phrase's lexemes: id and lemma."""
    spark = corpus.sparkSession
    words = spark.range(1).select(tokens(F.lit(phrase)).alias("w")).first()["w"]
    if not words:
        raise ValueError("the phrase has no token")
    return [(r["lexeme_id"], r["lemma"]) for r in resolve_words(spark, words, dictionary)]


def _matches(corpus: DataFrame, phrase: str, dictionary: Dictionary | None, context: int, compat: bool) -> DataFrame:
    """doc_id, pos, left, right (surfaces) of each match.

    A lexeme is met where one of its surfaces stands, so a row's own tokens tell where the phrase is: nothing is joined
    or shuffled for it, a row is a document whatever its id, and only places of the first word are looked at.
    """
    places = surfaces_of(corpus.sparkSession, phrase_lexemes(corpus, phrase, dictionary), dictionary)
    m = len(places)
    docs = token_rows(corpus)
    w = F.col("w")
    fits = lambda p: reduce(lambda a, b: a & b, [F.get(w, p + j).isin(*own) for j, own in enumerate(places)])
    docs = docs.where(F.size(w) >= m)
    first = once(docs, first=F.filter(F.sequence(F.lit(0), F.size(w) - m), lambda p: F.get(w, p).isin(*places[0])))
    hits = first.select("doc_id", "w", F.explode(F.filter("first", fits) if m > 1 else F.col("first")).alias("p"))
    least = F.greatest(F.lit(0), F.col("p") - context)
    if compat:  # the left side of a match that is nearer to the beginning than that is empty, not cut
        least = F.when(F.col("p") >= context - m - 1, least).otherwise(F.col("p"))
    left, right = F.slice(w, least + 1, F.col("p") - least), F.slice(w, F.col("p") + m + 1, F.lit(context)) if context else F.slice(w, 1, 0)
    return hits.select("doc_id", F.col("p").cast("long").alias("pos"), left.alias("left"), right.alias("right"))


def _lemmas(rows: DataFrame, sides: list[str], dictionary: Dictionary) -> DataFrame:
    """rows with the surfaces in the array columns `sides` replaced by structs of lexeme_id and lemma."""
    keyed = stored(rows.withColumn("hit", F.monotonically_increasing_id()), "hits")  # a task that runs again must not number its rows anew

    def places(s: str) -> Column:
        return F.transform(s, lambda x, k: F.struct(F.lit(s).alias("side"), k.alias("k"), x.alias("surface")))

    each = keyed.select(*(c for c in keyed.columns if c not in sides), F.explode_outer(F.concat(*map(places, sides))).alias("t"))
    named = annotate(each.select(*(c for c in each.columns if c != "t"), "t.side", "t.k", "t.surface"), dictionary)
    of = lambda s: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("k", "side", "lexeme_id", "lemma")), lambda x: x["side"] == s)), lambda x: F.struct(x["lexeme_id"].alias("lexeme_id"), x["lemma"].alias("lemma"))).alias(s)
    return named.groupBy(*(c for c in keyed.columns if c not in sides)).agg(*map(of, sides)).drop("hit")


def matches(corpus: DataFrame, phrase: str, dictionary: Dictionary | None = None, context: int = 0, compat: bool = False) -> DataFrame:
    """doc_id, pos, left, right: each match, overlapping ones too, with up to `context` lemmas on either side."""
    rows = _matches(corpus, phrase, dictionary, context, compat)
    if dictionary is None or not context:
        return rows
    lemma = lambda s: F.transform(s, lambda x: x["lemma"]).alias(s)
    return _lemmas(rows, ["left", "right"], dictionary).select("doc_id", "pos", lemma("left"), lemma("right"))


def concordance(corpus: DataFrame, phrase: str, context: int, threshold: int = 1, side: str = "all", dictionary: Dictionary | None = None, compat: bool = False, ordered: bool = True) -> DataFrame:
    """left, right (lemmas, space-joined), freq >= threshold; at most `context` lemmas on both sides together; the most frequent first.

    Contexts are counted by their lexemes: two lexemes of one lemma are two
    rows.  Equal contexts of surfaces are summed before they are looked up.
    side: 'left' (nothing on the right), 'right', 'both' (something on either side) or 'all'.
    compat: a match nearer to the beginning than context - length - 1 has no left side.
    """
    pairs = [(a, b) for a in range(context + 1) for b in range(context + 1 - a) if a + b]
    keep = {"left": lambda a, b: not b, "right": lambda a, b: not a, "both": lambda a, b: a and b, "all": lambda a, b: True}[side]
    if not (pairs := [x for x in pairs if keep(*x)]):
        return corpus.sparkSession.createDataFrame([], "left string, right string, freq long")
    cuts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    rows = _matches(corpus, phrase, dictionary, context, compat).select("left", "right", F.explode(cuts).alias("n")).where((F.size("left") >= F.col("n.a")) & (F.size("right") >= F.col("n.b")))
    left = F.when(F.col("n.a") > 0, F.slice("left", F.size("left") - F.col("n.a") + 1, F.col("n.a"))).otherwise(F.slice("left", 1, 0))
    rows = rows.select(left.alias("left"), F.slice("right", F.lit(1), F.col("n.b")).alias("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("freq"))
    if dictionary is not None:
        rows = _lemmas(rows, ["left", "right"], dictionary).groupBy("left", "right").agg(F.sum("freq").alias("freq"))
        text = lambda s: F.array_join(F.transform(s, lambda x: x["lemma"]), " ").alias(s)
    else:
        text = lambda s: F.array_join(s, " ").alias(s)
    out = rows.where(F.col("freq") >= threshold).select(text("left"), text("right"), "freq")
    return out.orderBy(F.desc("freq"), "left", "right") if ordered else out

"""Fixed-width reports: one text column, `line`, in order of `row`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.functions.text import number_cell, text_cell


def frequency_lines(frequencies: DataFrame) -> DataFrame:
    """lemma, part of speech, ipm, texts in cells of 20, 8, 16 and 8 characters."""
    return frequencies.select("lemma", "pos", F.concat(text_cell(F.col("lemma"), 20), text_cell(F.col("pos"), 8), number_cell(F.col("ipm"), 16, True), number_cell(F.col("texts"), 8)).alias("line"))


def concordance_lines(rows: DataFrame, keyword: str) -> DataFrame:
    """Left context to the right, keyword, right context, frequency; as wide as the longest."""
    width = rows.agg(F.coalesce(F.max(F.char_length("left")), F.lit(0)), F.coalesce(F.max(F.char_length("right")), F.lit(0))).first()
    left, right = F.lpad("left", width[0] or 1, " "), F.rpad("right", width[1] or 1, " ")
    return rows.select("left", "right", F.concat(left, F.lit(f" | {keyword} | "), right, number_cell(F.col("freq"), 8)).alias("line"))


def ngram_lines(ngrams: DataFrame, width: int = 40) -> DataFrame:
    return ngrams.select("gram", F.concat(text_cell(F.col("gram"), width), number_cell(F.col("occ"), 10), number_cell(F.col("tfidf"), 16, True)).alias("line"))


def pattern_lines(stats: DataFrame) -> DataFrame:
    return stats.select("model", F.concat(text_cell(F.col("model"), 32), number_cell(F.col("freq"), 8), number_cell(F.coalesce("tfidf", F.lit(float("nan"))), 8, True)).alias("line"))


def search_lines(results: DataFrame, width: int = 40) -> DataFrame:
    return results.select("doc_id", F.concat(text_cell(F.col("doc_id").cast("string"), width), number_cell(F.col("score"), 12, True)).alias("line"))


#: Headers of the reports (fixed values); an empty line follows each.
LEXEME_HEADER = "Lemma                PoS                   ipm    Texts"
UNKNOWN_HEADER = "Form               Occurences"
MODEL_HEADER = "Model                                Freq     TF-IDF"


def lexeme_report(frequencies: DataFrame) -> DataFrame:
    """line: the cells of frequency_lines with a space between."""
    return frequencies.select(F.concat_ws(" ", text_cell(F.col("lemma"), 20), text_cell(F.col("pos"), 8), number_cell(F.col("ipm"), 16, True), number_cell(F.col("texts"), 8)).alias("line"))


def unknown_report(frequencies: DataFrame) -> DataFrame:
    return frequencies.select(F.concat_ws(" ", text_cell(F.col("lemma"), 20), number_cell(F.col("occ"), 8)).alias("line"))


def concordance_report(rows: DataFrame, keyword: str) -> DataFrame:
    """Each word with a space behind it, sides as wide as the widest."""
    side = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(c, F.lit(" ")))
    rows = rows.withColumn("l", side("left")).withColumn("r", side("right"))
    width = rows.agg(*(F.coalesce(F.max(F.char_length(c)), F.lit(0)) for c in "lr")).first()
    pad = lambda c, n: F.repeat(F.lit(" "), F.lit(n) - F.char_length(c))
    return rows.select(F.concat(pad("l", width[0]), "l", F.lit(f"| {keyword} | "), "r", pad("r", width[1]), number_cell(F.col("freq"), 8)).alias("line"))


def ngram_report(ngrams: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines."""
    width = max(6, (ngrams.agg(F.max(F.char_length("gram"))).first()[0] or 0) + 1)
    return "N-gram" + " " * (width - 6) + "Occurences          TF-IDF", ngrams.select(F.concat(F.rpad("gram", width, " "), number_cell(F.col("occ"), 10), number_cell(F.col("tfidf"), 16, True)).alias("line"))


def model_report(stats: DataFrame, hits: DataFrame) -> DataFrame:
    """Each pattern's line, under it the words of its hits, then an empty line; a pattern without hits has 'inf' or nan for tfidf."""
    head = F.concat(text_cell(F.col("model"), 32), F.lit(" "), number_cell(F.col("freq"), 8), F.lit("   "), number_cell(F.coalesce("tfidf", F.lit(float("nan"))), 8, True))
    rows = stats.select("model", F.lit(0).alias("k"), F.lit("").alias("doc"), F.lit(0).cast("long").alias("pos"), head.alias("line"))
    rows = rows.unionByName(hits.select("model", F.lit(1).alias("k"), F.col("doc_id").cast("string").alias("doc"), "pos", F.concat(F.lit("  "), "forms", F.lit(" ")).alias("line")))
    rows = rows.unionByName(stats.select("model", F.lit(2).alias("k"), F.lit("").alias("doc"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("line")))
    return rows.orderBy("model", "k", "doc", "pos").select("line")


def search_report(results: DataFrame) -> tuple[str, DataFrame]:
    """Header and lines."""
    name = F.col("doc_id").cast("string")
    width = results.agg(F.max(F.char_length(name))).first()[0] or 0
    header = "Document".ljust(width) if width >= 8 else "Document"[: max(0, width - 1)] + "…" if width else ""
    return header + "        Score", results.select(F.concat_ws(" ", text_cell(name, width), number_cell(F.col("score"), 12, True)).alias("line"))


def write(lines: DataFrame, path: str, header: str | None) -> None:
    """Streams an ordered report to one local text file."""
    with open(path, "w", encoding="utf-8") as f:
        if header is not None:
            f.write(header + "\n")
        for r in lines.toLocalIterator():
            f.write(r["line"] + "\n")

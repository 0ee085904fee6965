"""Command line: python -m korpusflow {freq,concordance,ngrams,models,search} CORPUS DICTIONARY FREQUENCIES ..."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions.text import tokens
from korpusflow.operators import concordance, frequency, ngrams, patterns, report, search
from korpusflow.operators.morphology import Dictionary, resolve_words
from korpusflow.sources import corpus as C
from korpusflow.sources import resources as R


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="korpusflow", description="Corpus linguistics on Spark.")
    sub = p.add_subparsers(dest="task", required=True)

    def task(name: str, text: str) -> argparse.ArgumentParser:
        t = sub.add_parser(name, help=text)
        t.add_argument("corpus", help="folder of text files")
        t.add_argument("dictionary", help="dictionary XML")
        t.add_argument("frequencies", help="frequency list, tab-separated")
        t.add_argument("--snapshot", help="folder of a dictionary snapshot: read if it is there, else written")
        t.add_argument("--out", default=".", help="folder of the reports")
        return t

    task("freq", "frequency lists")
    t = task("concordance", "concordances of a phrase")
    t.add_argument("phrase")
    t.add_argument("context", type=int)
    t.add_argument("threshold", type=int)
    t.add_argument("--compat", action="store_true", help="no left side for matches nearer to the beginning than context - length - 1")
    t = task("ngrams", "stable n-grams, all or those with a phrase")
    t.add_argument("phrase")
    t.add_argument("frequency", type=int, nargs="?")
    t.add_argument("stability", type=float, nargs="?")
    t.add_argument("--ngrams", default="n-grams", help="folder of the n-grams found, read where no thresholds are given")
    t = task("models", "lexico-grammatical patterns")
    t.add_argument("thesaurus")
    t.add_argument("models")
    t = task("search", "BM25 search")
    t.add_argument("thesaurus")
    t.add_argument("query")
    return p


def dictionary_of(spark: SparkSession, args: argparse.Namespace) -> Dictionary:
    if args.snapshot:
        try:
            return Dictionary.load(spark, args.snapshot)
        except FileNotFoundError:
            pass
    found = Dictionary(*R.dictionary_xml(spark, args.dictionary), R.frequency_tsv(spark, args.frequencies))
    found.check()
    if args.snapshot:
        found.save(args.snapshot)
        return Dictionary.load(spark, args.snapshot)
    return found


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.time()
    dictionary, corpus = dictionary_of(spark, args), C.text_folder(spark, args.corpus)
    total = C.totals(corpus).first()
    print(f"Files:  {total.total_files}\nTokens: {total.total_words}\n\nRunning {args.task}...")

    def put(name: str, lines: DataFrame, header: str | None = None) -> None:
        report.write(lines, os.path.join(args.out, name), None if header is None else header + "\n")

    words = lambda text: spark.range(1).select(tokens(F.lit(text)).alias("w")).first()["w"]
    if args.task == "freq":
        every = frequency.frequency_list(corpus, dictionary, ids=True)
        put("freq.txt", report.lexeme_report(every.where(frequency.known(F.col("pos")))), report.LEXEME_HEADER)
        put("freq_no_function_words.txt", report.lexeme_report(every.where(frequency.content(F.col("pos")))), report.LEXEME_HEADER)
        put("freq_unknown.txt", report.unknown_report(every.where(frequency.unknown(F.col("pos")))), report.UNKNOWN_HEADER)
    elif args.task == "concordance":
        keyword = " ".join(r["lemma"] for r in resolve_words(spark, words(args.phrase), dictionary))
        for name, side in (("l", "left"), ("r", "right"), ("lr", "both")):
            put(f"concordances_{name}.txt", report.concordance_report(concordance.concordance(corpus, args.phrase, args.context, args.threshold, side, dictionary, args.compat), keyword))
    elif args.task == "ngrams":
        if args.frequency is not None:
            found = ngrams.stable_ngrams(corpus, None, args.frequency, 0.7 if args.stability is None else args.stability, dictionary)
            ngrams.save_snapshot(found, corpus, args.ngrams, dictionary)
        found = C.load(spark, f"{args.ngrams}/ngrams")
        print(f"Stable n-grams: {found.count()}")
        lemmas = [r["lemma"] for r in resolve_words(spark, words(args.phrase), dictionary)] if words(args.phrase) else []
        header, lines = report.ngram_report(ngrams.lookup(found, lemmas).orderBy(F.desc("tfidf"), "gram"))
        put("n-grams.txt", lines, (f"{args.phrase}\n" if len(lemmas) > 1 else "") + header)
    elif args.task == "models":
        models, thesaurus = R.models_xml(spark, args.models), R.thesaurus_xml(spark, args.thesaurus)
        put("models.txt", report.model_report(patterns.pattern_stats(corpus, models, dictionary, thesaurus), patterns.pattern_hits(corpus, models, dictionary, thesaurus)), report.MODEL_HEADER)
    else:
        header, lines = report.search_report(search.bm25(corpus, args.query, dictionary, R.thesaurus_xml(spark, args.thesaurus)))
        put("search_result.txt", lines, header)
    print(f"Done in {time.time() - began:.1f}s")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    try:
        run(SparkSession.builder.appName("korpusflow").getOrCreate(), args)
    except (FileNotFoundError, ValueError) as e:
        sys.exit(str(e))


if __name__ == "__main__":
    main()

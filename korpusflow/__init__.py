"""Corpus analytics on Spark: tokens, lemmas, concordances, n-grams, patterns, search."""

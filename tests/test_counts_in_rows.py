"""Counting within rows against plain counting, also where ids repeat or are null."""

from collections import Counter, defaultdict

from korpusflow.operators import frequency, ngrams
from korpusflow.operators.morphology import Dictionary
from korpusflow.sources.corpus import surface_counts

DOCS = [(1, "a b a b c"), (1, "a b"), (2, "b A a"), (None, "c c"), (None, "c d"), (3, None), (4, ""), (5, "en el en x")]


def test_lists_postings_and_grams(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    dictionary = Dictionary.of(spark, [(7, "la", "NOUN", [])], [(7, 0, "en", []), (7, 1, "el", [])], [], [])
    for d, name in ((None, lambda w: w), (dictionary, lambda w: "la" if w in ("en", "el") else w)):
        tf, grams = Counter(), defaultdict(list)
        for i, t in DOCS:
            w = [name(x) for x in (t or "").lower().split()]
            tf.update((x, i) for x in w)
            for x in zip(w, w[1:], strict=False):
                grams[" ".join(x)].append(i)
        assert sorted(map(tuple, frequency.postings(df, d).collect()), key=str) == sorted(((w, i, n) for (w, i), n in tf.items()), key=str)
        want = {(w, sum(n for (v, _), n in tf.items() if v == w), len({i for v, i in tf if v == w})) for w, _ in tf}
        assert {(x.lemma, x.occ, x.texts) for x in frequency.frequency_list(df, d).collect()} == want
        if d is None:
            assert {(x.gram, x.occ, x.df) for x in ngrams.gram_counts(df, 2).collect()} == {(g, len(x), len({*x})) for g, x in grams.items()}


def test_words_are_counted_before_any_shuffle(spark):
    df = spark.createDataFrame([(1, "a " * 1000 + "b")], "doc_id long, text string")
    assert sorted(map(tuple, surface_counts(df).collect())) == [(1, "a", 1000), (1, "b", 1)]

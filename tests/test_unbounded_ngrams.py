"""Stable n-grams without a limit against brute force."""

import random
from collections import defaultdict

import pytest

from korpusflow.operators import ngrams
from korpusflow.operators import prefixes as P
from korpusflow.operators.morphology import Dictionary
from korpusflow.sources.scratch import stored


def brute_force(docs, f, s):
    occ, where = defaultdict(int), defaultdict(set)
    for i, w in docs:
        for p in range(len(w)):
            for q in range(p + 2, len(w) + 1):
                occ[tuple(w[p:q])] += 1
                where[tuple(w[p:q])].add(i)
    lost = defaultdict(int)
    for g, c in occ.items():
        for part in (g[1:], g[:-1]):
            lost[part] = max(lost[part], c)
    return {" ".join(g): (len(g), c, len(where[g])) for g, c in occ.items() if c >= f and lost[g] <= c * s}


@pytest.mark.parametrize(("seed", "f", "s"), [(1, 2, 0.75), (2, 5, 0.5), (3, 3, 0.2), (4, 3, 1.0), (5, 1, 0.9)])
def test_equals_brute_force(spark, seed, f, s):
    r = random.Random(seed)
    base = [r.choice("abcdefgh") for _ in range(40)]
    docs = []
    for i in range(40 if s < 1 else 8):
        a, b = sorted(r.sample(range(41), 2))
        docs.append((i, [r.choice("abc") for _ in range(r.randrange(6))] + base[a:b] + ["x"] * r.randrange(9) + [r.choice("abc") for _ in range(r.randrange(6))]))
    if s < 1:
        docs += [(40 + i, list(base)) for i in range(6)] + [(50 + i, ["w"] * 30) for i in range(3)]
    docs += [(60, []), (61, ["a"]), (62, ["a", "b"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    found = ngrams.stable_ngrams(df, None, f, s)
    got = found.collect()
    want = brute_force(docs, f, s)
    assert len(got) == len({x.gram for x in got})
    assert {x.gram: (x.n, x.occ, x.df) for x in got} == want
    if seed == 1:
        kept = stored(found, "found")
        places = [tuple(x) for x in ngrams.occurrences(kept, df).collect()]
        assert len(places) == len({*places}) and {*places} == {(g, i, p) for g, (n, _, _) in want.items() for i, w in docs for p in range(len(w) - n + 1) if " ".join(w[p : p + n]) == g}
        pairs = [tuple(x) for x in ngrams.nested(kept).collect()]
        assert len(pairs) == len({*pairs}) and {*pairs} == {(g, h) for g in want for h in want if g != h and f" {h} " in f" {g} "}


def test_long_copies_cost_rows_in_proportion(spark, monkeypatch):
    """A gram of 3,000 tokens gives itself and what is stable inside; rows of every step stay below a few times the tokens."""
    r = random.Random(7)
    text = [f"w{r.randrange(500)}" for _ in range(3000)]
    docs = [(k, text[: 1000 * k] + ["x"] + text) for k in (0, 1, 2)]
    rows = []
    monkeypatch.setattr(ngrams, "stored", lambda df, name: rows.append((out := stored(df, name)).count()) or out)
    found = stored(ngrams.stable_ngrams(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), None, 3, 0.9), "found")
    long = {x.gram: (x.n, x.occ, x.df) for x in found.collect() if x.n >= 900}
    assert long == {"x " + " ".join(text): (3001, 3, 3), " ".join(text[:1000]): (1000, 5, 3), " ".join(text[:2000]): (2000, 4, 3)}
    assert max(rows) <= 2 * P.PARTS * sum(len(w) for _, w in docs)


def test_lexemes_of_one_lemma_are_one_gram(spark):
    lexemes = [(20, "la", "NOUN", []), (21, "la", "NOUN", [])]
    forms = [(20, 0, "en", []), (21, 0, "el", [])]
    dictionary = Dictionary.of(spark, lexemes, forms, [], [])
    df = spark.createDataFrame([(1, "en x"), (2, "el x"), (3, "q en x el x")], "doc_id long, text string")
    found = stored(ngrams.stable_ngrams(df, None, 2, 0.7, dictionary), "found")
    assert [(x.gram, x.occ, x.df) for x in found.collect()] == [("la x", 4, 3)]
    assert ngrams.occurrences(found, df, dictionary).count() == 4


def test_order_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c a b"), (2, "a b x c d"), (3, "c d"), (None, None)], "doc_id long, text string")
    got = ngrams.stable_ngrams(df, None, 2, 0.7, ordered=True).collect()
    assert [x.gram for x in got] == [x.gram for x in sorted(got, key=lambda x: (-x.tfidf, x.gram))] and {x.gram for x in got} == {"a b", "c d"}
    assert ngrams.stable_ngrams(df.where("doc_id > 9"), None, 2, 0.7).count() == 0


def test_the_filter_keeps_rare_grams_out_of_the_counting(spark):
    """Of 4,000 different tokens that stand once only the repeated run is counted; units are many, and equal to one."""
    docs = [(k, " ".join(f"u{k}x{j}" for j in range(200)) + " a b c d") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    units = P.units(df, "doc_id", "text")
    masks = P.frequent(units, 4, 4)
    assert {(x.m, x.n - x.i) for x in P.every_gram(units, [2, 3, 4], masks).collect()} == {(2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 3)}
    counts = P.gram_counts(units, masks, [2, 3, 4])
    assert [(x.n, x.occ, x.df) for x in counts.orderBy("n").collect()] == [(2, 20, 20)] * 3 + [(3, 20, 20)] * 2 + [(4, 20, 20)]


@pytest.mark.parametrize("unit", [1, 50])
def test_units_of_any_size_give_the_same(spark, monkeypatch, unit):
    docs = [(k, "a b c a b x " * (k % 3) + "r" * k) for k in range(30)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(P, "UNIT", unit)
    got = {x.gram: (x.n, x.occ, x.df) for x in ngrams.stable_ngrams(df, 3, 3, 0.7).collect()}
    long = brute_force([(i, (t or "").split()) for i, t in docs], 3, 0.7)
    assert got == {g: x for g, x in long.items() if x[0] <= 3}

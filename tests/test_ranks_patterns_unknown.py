"""Ranks, patterns by masks and kept unknown words, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from korpusflow.operators import morphology, patterns, ranks, search, unknown
from korpusflow.sources import snapshots


def test_ranks_equal_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice([7, 7, 7, r.randrange(50)]), f"w{i}") for i in range(3000)]  # most rows share a first key
    got = ranks.ranked(spark.createDataFrame(rows, "n long, w string").repartition(7), F.desc("n"), "w").collect()
    assert [(x.n, x.w) for x in sorted(got, key=lambda x: x["rank"])] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(x["rank"] for x in got) == list(range(1, 3001))
    assert ranks.ranked(spark.createDataFrame([], "n long"), "n").count() == 0
    nulls = ranks.ranked(spark.createDataFrame([(None,), (2,), (2,), (1,)], "n long"), "n").collect()
    assert [(x["rank"], x.n) for x in sorted(nulls, key=lambda x: x["rank"])] == [(1, None), (2, 1), (3, 2), (4, 2)]


@pytest.fixture(scope="module")
def pattern_corpus(spark):
    r = random.Random(5)
    docs = [(r.choice([1, 2, None, i]), " ".join(r.choice("abc") for _ in range(r.randrange(12)))) for i in range(60)]
    return docs, spark.createDataFrame([*docs, (3, None)], "doc_id long, text string")


def _models(many: bool):
    r = random.Random(6)
    token = lambda: r.choice([{"lemma": "a"}, {"wordform": "b"}, {}, {"lemma": "c"}, {"lemma": "zz"}])
    own = [(f"m{k}", [token() for _ in range(r.randrange(1, 4))]) for k in range(150 if many else 9)]
    return [*own, ("free", [{}]), ("free two", [{}, {}]), ("none", []), ("m0", [{"lemma": "a"}])]


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("include_last", [False, True])
def test_patterns_equal_brute_force(spark, pattern_corpus, many, include_last):
    docs, df = pattern_corpus
    models, want, stats = _models(many), [], []
    for name, ts in models:
        freq = texts = 0
        for doc, text in docs:
            w = text.split()
            last = len(w) - len(ts) + (1 if include_last else 0)
            at = [p for p in range(last) if ts and all((t.get("lemma") or t.get("wordform") or w[p + k]) == w[p + k] for k, t in enumerate(ts))]
            want += [(name, doc, p, " ".join(w[p : p + len(ts)])) for p in at]
            freq, texts = freq + len(at), texts + bool(at)
        stats.append((name, freq, texts))
    key = lambda x: tuple(str(y) for y in x)
    for table_bytes in (patterns.TABLE, 0):
        if many and not table_bytes:
            continue  # the join is the same for any number of patterns
        assert sorted((tuple(x) for x in patterns.pattern_hits(df, models, include_last=include_last, table_bytes=table_bytes).collect()), key=key) == sorted(want, key=key)
        assert sorted((x.model, x.freq, x.texts) for x in patterns.pattern_stats(df, models, include_last=include_last, table_bytes=table_bytes).collect()) == sorted(stats)


def test_patterns_without_shuffle_and_empty(spark, pattern_corpus):
    _, df = pattern_corpus
    hits = patterns.pattern_hits(df, _models(False))
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert patterns.pattern_hits(none, _models(False)).count() == 0 and patterns.pattern_hits(df, []).count() == 0 and patterns.pattern_stats(df, []).count() == 0
    assert {x.freq for x in patterns.pattern_stats(none, _models(False)).collect()} == {0}


def test_unknown_words_grow(spark, tmp_path):
    dictionary = morphology.Dictionary.of(spark, [(1, "дом", "NOUN", ["NOUN"])], [(1, 0, "дом", []), (1, 1, "дома", [])], [], [])
    one = spark.createDataFrame([(None, "дом съёмыш ёрш ерш"), (None, "съёмыш съёмыш"), (1, None)], "doc_id long, text string")
    two = spark.createDataFrame([(1, "Ёрш дома новьё")], "doc_id long, text string")
    path = f"{tmp_path}/words"
    assert unknown.load(spark, path) is None
    first = {r.surface: r for r in unknown.grow(path, one, dictionary).collect()}
    assert {s: (r.occ, r.texts) for s, r in first.items()} == {"съёмыш": (3, 2), "ёрш": (1, 1), "ерш": (1, 1)}
    both = unknown.grow(path, two, dictionary)
    after = {r.surface: r for r in both.collect()}
    assert {s: (r.occ, r.texts) for s, r in after.items()} == {"съёмыш": (3, 2), "ёрш": (2, 2), "ерш": (1, 1), "новьё": (1, 1)}
    assert all(after[s].lexeme_id == first[s].lexeme_id for s in first) and len({r.lexeme_id for r in after.values()}) == 4
    # a spelling with е that is a word itself isn't an alias
    assert {r.alias: r.surface for r in unknown.aliases(both, dictionary).collect()} == {"съемыш": "съёмыш", "новье": "новьё"}
    # a version without manifest, as a killed writer leaves it, isn't seen
    both.limit(1).write.parquet(f"{path}/half/unknown")
    assert unknown.load(spark, path).count() == 4 and snapshots.version_at(spark, path) != f"{path}/half"
    known = dictionary.knowing(both, unknown.aliases(both, dictionary))
    docs = spark.createDataFrame([(1, "съёмыш"), (2, "дом"), (3, "окно")], "doc_id long, text string")
    assert search.bm25(docs, "съемыш", dictionary).count() == 0
    assert [r.doc_id for r in search.bm25(docs, "съемыш", known).collect()] == [1]


def test_unknown_ids_of_few_bits_stay_apart(spark):
    found = spark.createDataFrame([(f"w{k}", 1, 1) for k in range(40)], "surface string, occ long, texts long")
    first = unknown.merged(None, found, bits=3)
    ids = {r.surface: r.lexeme_id for r in first.collect()}
    assert len(set(ids.values())) == 40 and max(ids.values()) < -1
    more = unknown.merged(first, spark.createDataFrame([(f"w{k}", 1, 1) for k in range(20, 60)], "surface string, occ long, texts long"), bits=3)
    again = {r.surface: (r.lexeme_id, r.occ) for r in more.collect()}
    assert len({i for i, _ in again.values()}) == 60 and all(again[w][0] == ids[w] for w in ids) and again["w25"][1] == 2 and again["w1"][1] == 1

"""The stored index against scans, and snapshots that break off."""

import random

import pytest

from korpusflow.operators import concordance, index, search
from korpusflow.operators.morphology import Dictionary
from korpusflow.sources import snapshots


def corpus(spark, seed=1, n=400):
    r = random.Random(seed)
    words = ["a", "b", "c", "rare", "x", "y"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(r.choices(words, [9, 5, 3, 0.05, 1, 1] + [1] * 60, k=r.randrange(60)))) for k in range(n)]
    docs += [(None, "a a a b"), (7, "a b a b a"), (900, None), (901, ""), (902, "a " * 3000)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_scans(spark, tmp_path):
    docs = corpus(spark)
    i = index.build_index(docs, f"{tmp_path}/i")
    assert (i.files, index.open_index(spark, f"{tmp_path}/i").words) == (405, i.words)
    for query in ("b rare", "rare", "a x", "nothing", "a b c rare x y w1 w2"):
        want = search.bm25(docs, query)
        assert rows(index.bm25(i, query)) == rows(want), query
        top, read, every = index.best(i, query, 5)
        assert [tuple(x) for x in top.collect()] == [tuple(x) for x in want.limit(5).collect()], query
        assert read <= every
    for phrase in ("a b", "a a", "a b a", "rare", "w1 nothing"):
        assert rows(index.phrase_places(i, phrase)) == rows(concordance.matches(docs, phrase).select("doc_id", "pos")), phrase


def test_blocks_that_promise_too_little_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, "z" + " q" * (1 + (k < 20)) + " f" * (k % 50)) for k in range(4000)] + [(5000 + k, "o") for k in range(9000)], "doc_id long, text string").coalesce(1)
    i = index.build_index(docs, f"{tmp_path}/i")
    top, read, every = index.best(i, "q", 3)
    assert [tuple(x) for x in top.collect()] == [tuple(x) for x in search.bm25(docs, "q").limit(3).collect()]
    assert every == 32 and read < every / 2


def test_only_the_buckets_of_the_query_are_read(spark, tmp_path):
    i = index.build_index(corpus(spark), f"{tmp_path}/i")
    plan = i.postings([(index_id(spark, "b"), "b")])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "places" not in plan.split("ReadSchema: ")[-1]


def index_id(spark, word):
    from korpusflow.operators.morphology import resolve_words

    return resolve_words(spark, [word], None)[0]["lexeme_id"]


def test_with_a_dictionary(spark, tmp_path):
    d = Dictionary.of(spark, [(1, "be", "VERB", [])], [(1, 0, "a", []), (1, 1, "b", [])], [], [])
    docs = corpus(spark, 3, 60)
    i = index.build_index(docs, f"{tmp_path}/i", d)
    assert rows(index.bm25(i, "a x")) == rows(search.bm25(docs, "a x", d))
    assert rows(index.phrase_places(i, "a x")) == rows(concordance.matches(docs, "a x", d).select("doc_id", "pos"))


def test_a_snapshot_that_breaks_off_leaves_the_one_before(spark, tmp_path):
    path = f"{tmp_path}/s"
    old, new = spark.range(3), spark.range(5)
    assert snapshots.version_at(spark, path) is None
    first = snapshots.publish(spark, path, {"a": old, "b": old})
    broken = new.selectExpr("id", "raise_error('killed') AS x")
    with pytest.raises(Exception, match="killed"):
        snapshots.publish(spark, path, {"a": new, "b": broken})
    assert snapshots.version_at(spark, path) == first and spark.read.parquet(f"{first}/a").count() == 3
    (tmp_path / "s" / "_manifests" / "000000000009-half").write_text("half comp")  # a manifest cut short
    assert snapshots.version_at(spark, path) == first
    second = snapshots.publish(spark, path, {"a": new, "b": new})
    third = snapshots.publish(spark, path, {"a": new, "b": new})
    assert snapshots.version_at(spark, path) == third and snapshots.exists(spark, f"{second}/b") and not snapshots.exists(spark, f"{first}/a")


def test_a_dictionary_snapshot_has_the_resolution(spark, tmp_path):
    d = Dictionary.of(spark, [(1, "be", "VERB", [])], [(1, 0, "is", [])], [], [])
    d.save(f"{tmp_path}/d")
    assert rows(Dictionary.load(spark, f"{tmp_path}/d").resolution().select("surface", "lemma")) == [("is", "be")]
    with pytest.raises(FileNotFoundError):
        Dictionary.load(spark, f"{tmp_path}/none")

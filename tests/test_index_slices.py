"""The index is shuffled by slices of its buckets, once each."""

from korpusflow.operators import index, search
from korpusflow.operators.morphology import Dictionary
from korpusflow.sources import snapshots


def test_slices_equal_a_scan(spark, tmp_path, monkeypatch):
    own = Dictionary.of(spark, [(1, "be", "VERB", [])], [(1, 0, "is", []), (1, 1, "was", [])], [], [])
    texts = [(k, f"is w{k % 7} was is" if k % 5 == 0 else f"w{k % 11} x w{k % 3}") for k in range(300)]
    corpus = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    written = []
    monkeypatch.setattr(index, "WORDS", 6)
    monkeypatch.setattr(snapshots, "publish", lambda s, p, t, by=None, f=snapshots.publish: written.append(t) or f(s, p, t, by))
    built = index.build_index(corpus, str(tmp_path / "i"), own)
    assert len(written[0]["postings"]) == index.SLICES
    got = sorted(map(tuple, index.bm25(built, "is w3").collect()))
    assert got and got == sorted(map(tuple, search.bm25(corpus, "is w3", own).collect()))

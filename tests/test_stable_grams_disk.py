"""Stable n-grams without a limit: questions by buckets and slices, and what is left on disk."""

import random
import time
from pathlib import Path

from korpusflow.operators import ngrams
from korpusflow.operators import prefixes as P
from korpusflow.sources.scratch import stored
from tests.test_unbounded_ngrams import brute_force


def test_many_buckets_and_slices_equal_brute_force(spark, monkeypatch):
    r = random.Random(11)
    base = [r.choice("abcd") for _ in range(70)]
    docs = [(k, ["s"] * r.randrange(4) + base[(a := r.randrange(60)) : a + r.randrange(3, 70)] + ["t"] * r.randrange(12)) for k in range(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(P, "_KEYS", 20)
    got = {x.gram: (x.n, x.occ, x.df) for x in ngrams.stable_ngrams(df, None, 4, 0.6).collect()}
    assert got == brute_force(docs, 4, 0.6) and max(n for n, *_ in got.values()) > 16


def test_no_shuffle_files_are_left(spark):
    """Shuffles of a step are gone when it is stored: they stayed until the driver's garbage was collected."""
    folders = [Path(spark.sparkContext._jsc.sc().getConf().get("spark.local.dir", "/tmp"))]
    count = lambda: {p for f in folders for p in f.glob("blockmgr-*/*/shuffle_*.data")}
    before = count()
    kept = stored(spark.range(1000).repartition(7, "id").groupBy("id").count(), "counts")
    for _ in range(50):
        if not count() - before:
            break
        time.sleep(0.1)
    assert not count() - before and kept.count() == 1000

"""op2's questions by way of units: the same scores, and rows that grow with the text."""

import random

import numpy as np
import pytest

from korpusflow.llm import lm


@pytest.mark.parametrize(("buckets", "fan"), [(1, 128), (7, 128), (7, 2), (130, 128), (1000, 5)])
def test_keys_reach_their_buckets(buckets, fan):
    levels, r = lm.Levels(buckets, fan), np.random.default_rng(4)
    assert levels.buckets >= buckets and (levels.levels == 1 or levels.fan <= fan)
    for block in (0, 5, (3 << 33) + 2):
        keys = r.integers(0, 1 << 48, 500, dtype=np.uint64)
        at = [(block, keys)]
        for level in range(levels.levels):
            at = [(unit, k[places]) for source, k in at for unit, places in levels.split(level, source, k)]
        assert sum(len(k) for _, k in at) == 500 and all((lm.bucket_of(k, levels.buckets) == unit).all() for unit, k in at)
        assert list(levels.split(0, block, keys[:0])) == []


def _docs(spark, n):
    r = random.Random(n)
    words = ["alpha", "beta", "gamma", "Delta", "ünder", "x", "y1"]
    return spark.createDataFrame([(k, " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(12))) for k in range(n)] + [(n, None), (n + 1, "")], "doc_id long, text string").coalesce(2)


@pytest.mark.parametrize("fan", [2, 3])
def test_scores_are_the_same_by_any_way(spark, fan):
    docs = _docs(spark, 60)
    get = lambda **k: {r.doc_id: tuple(r) for r in lm.score_texts(docs, depth=3, block_bytes=600, **k).collect()}
    near, far = get(), get(fan=fan)
    assert lm.Levels(round(60 * 75 / 600), fan).levels > 1 and near.keys() == far.keys()
    for k, row in near.items():
        assert row[:5] == far[k][:5] and row[5:] == pytest.approx(far[k][5:], rel=1e-6)


def test_rows_grow_with_the_text(spark, monkeypatch):
    written, stored = [], lm.stored

    def counting(df, name, *by):
        out = stored(df, name, *by)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(lm, "stored", counting)
    rows = []
    for n in (64, 128):
        written.clear()
        lm.score_texts(_docs(spark, n), depth=3, block_bytes=600, fan=4).count()
        rows.append(sum(k for name, k in written if name in ("lm-blocks", "lm-grams", "lm-word-sums", "lm-answers", "lm-words")))
    # twice the blocks: twice the rows, and at most a level more; by blocks times buckets it would be four times
    assert rows[1] <= 3 * rows[0]

"""Hard negatives against plain sorting."""

import math

import numpy as np
import pytest

from korpusflow.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows):
    use = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = label
        if i is not None and i % 7 == 0:
            own = label + 1 - 10 * int((label + 1) / 10)
        use.append((k, i, own, [math.floor(256 * x) for x in v]))
    out = []
    by_rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, i, label, v in use:
        if i is None or i % 50:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, l) for m, j, l, w in use if m != k]
        for p in sorted((s for s in scores if s[2] == label), key=by_rank)[:5]:
            near = [s for s in scores if s[2] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]]
            out += [(i, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(sorted(near, key=by_rank)[:3], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "scale", "dim"), [(1, 1.0, 64), (2, 0.02, 6), (3, 3e4, 9), (4, 1e-4, 3)])
def test_equals_sorting(spark, monkeypatch, seed, scale, dim):
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "ROWS", 90)
    r = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in scale * r.normal(size=dim) / 8], int(r.choice(10, p=[0.4, 0.2, *[0.05] * 8]))) for k in range(0, 1500, 5)]
    rows += [(50, rows[3][1], 2), (50, rows[3][1], 2), (101, rows[0][1], rows[0][2]), (None, rows[0][1], 3), (150, None, 1), (200, [], 1), (250, [1.0, None], 1), (300, [float("nan")] * dim, 2), (350, rows[1][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS uid", "2 AS score", "3 AS targets").repartition(4)
    assert result(H.hard_negatives(df)) == brute_force(rows)


def test_edges(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], SCHEMA)).count() == 0
    rows = [(0, [1.0, 1.0], 0), (7, [0.5, 0.5], 0), (14, [0.5, 0.5], -11), (50, [1.0], 1), (1, [0.9], 2), (2, [0.9, 5.0, 5.0], 2), (100, [-1.0, 2.0], 1), (3, [0.0, 0.0], 1)]
    assert result(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)
    huge = [(50, [1e300, -1e300], 1), (51, [1e300, 1.0], 1), (52, [1e299, 1.0], 2)]
    assert H.hard_negatives(spark.createDataFrame(huge, SCHEMA)).count() <= 1


def test_bit_planes():
    x = np.array([[-256, 255, 0, -1, 7], [5, -5, 128, -128, 1]])
    assert (sum(w * p.astype(int) for w, p in H.bit_planes(x)) == x).all()
    assert (sum(w * p.astype(int) for w, p in H.bit_planes(np.zeros((1, 2), int))) == 0).all()

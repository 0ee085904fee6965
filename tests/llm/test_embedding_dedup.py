"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from korpusflow.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows):
    ok = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {k: np.array(rows[k][1], dtype=np.float32).astype(float) for k in ok}
    units = {k: v / np.sqrt(v @ v) for k, v in units.items()}
    root, links = list(range(len(rows))), [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min([x for x in (least.get(root[k]), i) if x is not None], default=None)
    return sorted(((i, links[k], least[root[k]], i == least[root[k]]) for k, (i, _, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def some_vectors(seed, dim, n=150):
    """Families about a few centres, at all similarities around 0.98, copies, and lone vectors."""
    r = np.random.default_rng(seed)
    centres, out = r.normal(size=(6, dim)), []
    for k in range(n):
        c, far = centres[r.integers(6)], r.choice([0.0, 0.05, 0.14, 0.2, 0.3])
        v = c / np.linalg.norm(c) + far * r.normal(size=dim) / np.sqrt(dim)
        out.append((k, [float(x) for x in np.float32(v * r.choice([1, 7]))], int(r.integers(2))))
    return out + [(1000 + k, v, l) for k, (_, v, l) in enumerate(out[:30])]


@pytest.mark.parametrize(("dim", "depth"), [(64, 1), (64, 2), (64, 4), (16, 3), (5, 1), (2, 1), (1, 1)])
def test_equals_all_pairs(spark, dim, depth):
    rows = some_vectors(dim, dim)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS kind", "0 AS component_id").repartition(3)
    assert result(E.embedding_dedup(df, depth=depth)) == brute_force(rows)


def test_long_lists_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = some_vectors(3, 8, 200)
    assert result(E.embedding_dedup(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25, -1.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [0.5, None, -1.0], 1), (9, [nan, 0.25, -1.0], 1), (10, [inf, 0.25, -1.0], 1),
        (11, [0.5, 0.25, -1.0, 0.0], 1), (None, None, None), (12, [1e-30, 5e-31, -2e-30], 1), (13, [1e38, 5e37, -2e38], 1), (14, [-0.5, -0.25, 1.0], 1),
    ]
    got = result(E.embedding_dedup(spark.createDataFrame(rows, SCHEMA)))
    want = [(i, n, c, i is None if c is None else i == c) for i, n, c, _ in brute_force(rows)]
    assert got == sorted(want, key=str)
    assert (12, 5, 1, False) in got and (14, 0, 14, True) in got
    assert E.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.98 exactly: the share that shares enough of its nearest pivots."""
    r = np.random.default_rng(1)
    x, z = r.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    pivots = E.choose_pivots(r.normal(size=(500, 64)), 64)
    a, b = E.permutations_of(x, pivots), E.permutations_of(y, pivots)
    shared = (a[:, :, None] == b[:, None]).sum((1, 2))
    assert len(pivots) == E.PIVOTS and (shared >= E.SHARED).mean() > 0.998


def test_each_pair_meets_in_one_list():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = (sorted(r.choice(16, E.NEAREST, replace=False).tolist()) for _ in range(2))
        both = sorted({*a} & {*b})
        for depth in (1, 2, 3, 4):
            if len(both) >= E.SHARED:
                assert tuple(both[:depth]) in {*E.list_keys(a, depth, E.SHARED)} & {*E.list_keys(b, depth, E.SHARED)}

"""The label model: against EM written plainly, on planted accuracies, and against all-must-pass."""

import math

import numpy as np
import pytest

from korpusflow.llm import quality_model, quality_rules, weak


def plain_em(rows, n, kinds, rounds):
    """EM document by document, as it is defined."""
    name = lambda c, j: "good" if c == 0 else "own" if j in kinds[c - 1] else "other"
    classes = range(len(kinds) + 1)
    finds = [[weak.BEGIN[name(c, j)] for j in range(n)] for c in classes]
    share = [weak.BEGIN["share"], *[(1 - weak.BEGIN["share"]) / len(kinds)] * len(kinds)]
    begin, first = [list(x) for x in finds], list(share)

    def of(v):
        p = [share[c] * math.prod(finds[c][j] if v[j] == weak.BAD else 1 - finds[c][j] if v[j] == weak.GOOD else 1 for j in range(n)) for c in classes]
        return [x / sum(p) for x in p]

    for _ in range(rounds):
        own = [of(v) for v in rows]
        new = []
        for c in classes:
            new.append([])
            for j in range(n):
                bad, good = (sum(p[c] for p, v in zip(own, rows) if v[j] == x) for x in (weak.BAD, weak.GOOD))
                new[c].append(min(weak.MOST[name(c, j)], max(weak.LEAST[name(c, j)], (bad + weak.PRIOR * begin[c][j]) / (bad + good + weak.PRIOR))))
        sizes = [sum(p[c] for p in own) for c in classes]
        share = [(s + weak.PRIOR * f) / (sum(sizes) + weak.PRIOR) for s, f in zip(sizes, first)]
        finds = new
    return [of(v)[0] for v in rows]


@pytest.mark.parametrize("kinds", [((0, 1, 2, 3, 4),), ((0, 1, 2), (2, 3, 4))])
def test_em_is_em(kinds):
    r = np.random.default_rng(3)
    rows = r.choice(3, (300, 5), p=[0.15, 0.2, 0.65])
    codes, n = np.unique([weak.code(v) for v in rows.tolist()], return_counts=True)
    got = weak.fit(codes, n, 5, kinds, rounds=12).posterior(rows)
    assert np.abs(got - np.array(plain_em(rows.tolist(), 5, kinds, 12))).max() < 1e-9


def planted(seed=5, size=40_000):
    """Votes of five labellers that see one kind; the last is poor: of good documents it finds a tenth bad."""
    r = np.random.default_rng(seed)
    good = r.random(size) < 0.85
    finds = np.array([[0.9, 0.85, 0.8, 0.75, 0.5], [0.01, 0.02, 0.03, 0.02, 0.1]])
    silent = np.array([0.1, 0.1, 0.2, 0.1, 0.1])
    votes = np.where(r.random((size, 5)) < silent, weak.ABSTAIN, np.where(r.random((size, 5)) < finds[good.astype(int)], weak.BAD, weak.GOOD))
    return good, votes


def test_accuracies_and_lone_votes():
    good, votes = planted()
    codes, n = np.unique([weak.code(v) for v in votes.tolist()], return_counts=True)
    m = weak.fit(codes, n, 5)
    right = [((votes[:, j] == weak.GOOD) & good | (votes[:, j] == weak.BAD) & ~good).sum() / (votes[:, j] != weak.ABSTAIN).sum() for j in range(5)]
    assert np.abs(m.accuracy - right).max() < 0.02
    p = m.posterior(votes)
    assert ((p > 0.5) == good).mean() > 0.97
    poor = np.array([[weak.GOOD] * 4 + [weak.BAD]])
    assert m.posterior(poor)[0] > 0.95  # all-must-pass would drop it
    assert m.posterior(np.array([[weak.BAD, weak.BAD, weak.GOOD, weak.GOOD, weak.GOOD]]))[0] < 0.5
    lone = ((votes == weak.BAD).sum(1) == 1) & (votes[:, 4] == weak.BAD)
    assert lone.sum() > 1000 and good[lone].mean() > 0.95 and (p[lone] > 0.5).mean() > 0.95


@pytest.mark.parametrize("op", ["rules", "model"])
def test_nulls_ties_and_extra_columns(spark, op):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(["th", "er", "in", "an", "ost", "e", "al"], 3))
    text = "\n".join(" ".join(word() for _ in range(10)).capitalize() + "." for _ in range(20))
    junk = "# " * 200
    rows = [(None, text, 1, "x"), (None, junk, 2, "y"), (3, text, 3, "x"), (3, text, 3, "x"), (3, junk, 4, "x"), (4, None, 5, None), (5, "", 6, "")]
    rows += [(10 + k, f"{text}\nAnd so {word()}.", 7, "z") for k in range(60)]
    schema = "doc_id long, text string, n_words long, __seen string"
    f = quality_rules.quality_rules if op == "rules" else quality_model.quality_classifier
    got = f(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.text == text) and not any(r.kept for r in got if r.text == junk)
    assert sum(r.doc_id is None and r.kept for r in got) == 1 and {r["__seen"] for r in got} == {"x", "y", "z", "", None}
    assert f(spark.createDataFrame([], schema)).count() == 0
    thin = f(spark.createDataFrame(rows, schema), keep=["doc_id"])
    assert "text" not in thin.columns and thin.count() == len(rows)

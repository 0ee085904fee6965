"""Weak supervision: what overlapping labellers' votes say, by expectation-maximisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Votes.
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Where EM begins: how often a labeller that votes finds a document bad, by the document's class: a good one, one bad in
#: the labeller's own kind, one bad in another kind; and the share of good documents.
BEGIN = {"good": 0.02, "own": 0.8, "other": 0.05, "share": 0.85}
#: Pseudo-documents that vote as EM began, for each class and labeller, and for each class.
PRIOR = 1.0
#: A labeller finds what it looks for more often than chance finds it, a good document seldom; nobody is infallible.
LEAST, MOST = {"good": 1e-3, "own": 0.25, "other": 1e-3}, {"good": 0.25, "own": 0.995, "other": 0.95}


def code(votes: list[int]) -> int:
    """A document's votes as one number, the first the most significant digit of base 3."""
    out = 0
    for v in votes:
        out = 3 * out + v
    return out


def code_column(votes: Column, n: int) -> Column:
    return sum((F.element_at(votes, i + 1).cast("long") * 3 ** (n - 1 - i) for i in range(n)), F.lit(0).cast("long"))


def digits(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([codes // 3 ** (n - 1 - i) % 3 for i in range(n)], axis=1) if n else np.zeros((len(codes), 0), int)


@dataclass
class LabelModel:
    """Class 0: good documents; the others are bad, each in a kind of its own.

    finds: how often each labeller that votes finds a document of each class bad.
    """

    finds: np.ndarray  # classes x labellers
    share: np.ndarray
    accuracy: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each class for documents with these votes (rows).  Abstaining says nothing."""
        z = np.log(self.share) + (votes == BAD) @ np.log(self.finds).T + (votes == GOOD) @ np.log1p(-self.finds).T
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes (rows) are good."""
        return self.classes(votes)[:, 0]


def fit(codes: np.ndarray, counts: np.ndarray, n: int, kinds: tuple[tuple[int, ...], ...] | None = None, rounds: int = 100) -> LabelModel:
    """EM over the counts of vote patterns (at most 3 ** n).

    kinds: the ways in which a document can be bad, each the labellers that
    look for it (default: one way, which all look for).  Labellers overlap, so
    those of a kind tell how far each can be trusted: given the class they are
    independent, and without it their votes go together.  A labeller whose
    bad votes the others of its kind don't share is learnt to err, and one
    that belongs to no kind only tells what the classes look like to it.
    """
    kinds = kinds or (tuple(range(n)),)
    votes, weight = digits(np.asarray(codes, dtype=np.int64), n), np.asarray(counts, dtype=np.float64)
    name = np.array([["good"] * n, *(["own" if j in kind else "other" for j in range(n)] for kind in kinds)])
    begin, least, most = (np.vectorize(x.get, otypes=[float])(name) for x in (BEGIN, LEAST, MOST))
    share = np.array([BEGIN["share"], *[(1 - BEGIN["share"]) / len(kinds)] * len(kinds)])
    model = LabelModel(begin, share, np.zeros(n))
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    for _ in range(rounds):
        own = model.classes(votes) * weight[:, None]
        found, passed = own.T @ bad, own.T @ good
        finds = np.clip((found + PRIOR * begin) / (found + passed + PRIOR), least, most)
        right = (found[1:].sum(0) + passed[0]) / np.maximum(1e-9, (found + passed).sum(0))
        model = LabelModel(finds, (own.sum(0) + PRIOR * share) / (own.sum() + PRIOR), right)
    return model

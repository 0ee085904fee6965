"""Quality classifier: weak labels by EM, then a hashed linear scorer trained on their posterior."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm import weak
from korpusflow.llm.common import fresh, stored
from korpusflow.llm.weak import ABSTAIN, BAD, GOOD

RESULTS = ("weak_label", "score", "kept")
DIMENSIONS = 1 << 12
#: So many documents, those of the smallest hash, train the scorer.
SAMPLE = 20_000
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
_SPACE = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"]
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")
_MARKED = re.compile(rb"[#*$%&|<>](?=\s|\Z)")


def shapes(word: str) -> list[str]:
    """Runs of upper-case, lower-case, digits and other characters, by up to eight: "Don't!!" is ["Aa'a!"]; of a long word every piece."""
    out: list[str] = []
    last = None
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if k != last:
            out.append(k)
            last = k
    return ["".join(out[at : at + 8]) for at in range(0, len(out), 8)]


_places: dict[str, list[int]] = {}


def _places_of(word: str) -> list[int]:
    """The dimensions of a word's shapes."""
    if (got := _places.get(word)) is None:
        got = [zlib.crc32(x.encode()) % DIMENSIONS for x in shapes(word)]
        if len(word) <= 256:
            if len(_places) > 300_000:
                _places.clear()
            _places[word] = got
    return got


@dataclass(slots=True)
class Profile:
    """What labellers and scorer know of a text."""

    votes: list[int]
    places: list[int]
    values: list[float]


def profile(text: str) -> Profile:
    data = text.encode()
    words = text.split()
    n = len(words)
    size = max(1, len(data) - sum(map(data.count, _SPACE)))
    pieces = Counter(chain.from_iterable(map(_places_of, words)))
    same = sum(map(str.__eq__, words, words[1:])) / max(1, n)
    distinct = len(set(words)) / max(1, n)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    twice = 1 - len(set(lines)) / len(lines) if lines else 0.0
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _UPPER.lower()))
    single = list(map(len, words)).count(1) / max(1, n)
    symbols = sum(map(data.count, _SYMBOLS)) / max(1, n)
    marked = len(_MARKED.findall(data)) if symbols else 0
    votes = [
        _by(symbols, 0.02, 0.1, n >= 5),
        _by(upper / max(1, upper + lower), 0.25, 0.5, upper + lower >= 20),
        _by(same, 0.05, 0.2, n >= 8),
        _by(-distinct, -0.45, -0.25, n >= 20),
        _by(twice, 0.1, 0.45, len(lines) >= 4),
        _by(single, 0.12, 0.3, n >= 8),
        _by(marked / max(1, n), 0.02, 0.1, n >= 5),
        _by((len(data) - len(data.translate(None, _MARKS))) / size, 0.12, 0.25, n >= 5),
    ]
    total = pieces.total()
    capitals = sum(map(str.isupper, words)) / max(1, n)
    ended = sum(x.rstrip().endswith(_ENDS) for x in lines)
    votes += [_by(capitals, 0.1, 0.4, n >= 8), _by(-ended / max(1, len(lines)), -0.5, -0.1, len(lines) >= 3)]
    values = {k: (v / total) ** 0.5 for k, v in pieces.items()}
    for name, value in (("same", same), ("repeats", max(0.0, 0.5 - distinct) if n >= 20 else 0.0), ("lines", twice if len(lines) >= 4 else 0.0), ("single", single if n >= 8 else 0.0)):
        if value:
            k = zlib.crc32(f" {name}".encode()) % DIMENSIONS
            values[k] = values.get(k, 0.0) + value**0.5
    return Profile(votes, list(values), list(values.values()))


def _by(value: float, good: float, bad: float, enough: bool) -> int:
    return ABSTAIN if not enough else GOOD if value <= good else BAD if value >= bad else ABSTAIN


N_LABELLERS = len(profile("").votes)
#: The labellers that look for symbols, repeated words, repeated lines, capitals.
KINDS = ((0, 5, 6, 7), (2, 3, 4), (3, 4), (1, 8))


def train(places: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, rounds: int = 400, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the constant.  Full gradients with Adam's steps."""
    size = np.array([len(p) for p in places], dtype=np.int64)
    row = np.repeat(np.arange(len(places)), size)
    col = np.concatenate(places) if len(places) else np.zeros(0, np.int64)
    val = np.concatenate(values) if len(values) else np.zeros(0)
    w, m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    if not len(target):
        w[-1] = 3.0
        return w
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=val * w[col], minlength=len(target)) + w[-1]
        error = 1 / (1 + np.exp(-z)) - target
        g = np.append(np.bincount(col, weights=val * error[row], minlength=DIMENSIONS), error.sum()) / len(target) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """Adds weak_label (posterior of the labellers' votes), score (the scorer's probability) and kept (score >= threshold).

    keep: the columns to return beside these (default: all).  Columns of docs
    named like a result give way to it.

    Labellers' accuracies come from the vote patterns of all documents.  The
    scorer learns from the `sample` different (id, text) of the smallest hash.
    Features are the shapes of words, hashed, and how much repeats; not the
    words, so that it judges any language.  Null and empty texts get no votes
    and no features: they are judged by the constant alone.  Each row is judged
    by itself, whatever its id; rows that repeat are judged alike; an empty
    table gives no row.  Where the texts aren't returned, each is read once: its
    votes and features are written with the columns to return; where they are,
    reading them twice takes less than writing them.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    seen, drawn = fresh("__seen", docs), fresh("__drawn", docs)

    @F.pandas_udf("code long, places array<int>, values array<float>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            got = [profile(t or "") for t in batch]
            yield pd.DataFrame({"code": pd.Series([weak.code(p.votes) for p in got], dtype="int64"), "places": [np.array(p.places, np.int32) for p in got], "values": [np.array(p.values, np.float32) for p in got]})

    table = docs.select(*names, F.xxhash64(id_col, text_col).alias(drawn), features(F.col(text_col)).alias(seen))
    if text_col not in names:
        table = stored(table, "quality-features")
    found = table.groupBy(F.col(f"{seen}.code")).count().collect()  # at most 3 ** N_LABELLERS rows
    codes, n = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.int64)
    labels = weak.fit(codes, n, N_LABELLERS, KINDS)
    share = min(1.0, 1.2 * sample / max(1, int(n.sum())))  # different rows are fewer than rows; a limit follows
    few = table.where(F.col(drawn) < int((share - 0.5) * 2**64)) if share < 1 else table
    rows = few.select(F.col(drawn).alias("k"), F.col(seen).alias("f")).dropDuplicates(["k"]).orderBy("k").limit(sample).select("f.*").collect()
    target = labels.posterior(weak.digits(np.array([r[0] for r in rows], dtype=np.int64), N_LABELLERS)) if rows else np.zeros(0)
    weights = train([np.array(r[1], np.int64) for r in rows], [np.array(r[2], np.float64) for r in rows], target)

    @F.pandas_udf("weak_label double, score double")
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            label = labels.posterior(weak.digits(got["code"].to_numpy(dtype=np.int64), N_LABELLERS))
            z = [weights[-1] + (weights[p] @ v if len(p) else 0.0) for p, v in zip(got["places"], got["values"], strict=True)]
            yield pd.DataFrame({"weak_label": label, "score": 1 / (1 + np.exp(-np.array(z, dtype=np.float64)))})

    out = table.select(*names, judged(F.col(seen)).alias(seen)).select(*names, F.col(f"{seen}.weak_label").alias("weak_label"), F.col(f"{seen}.score").alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)

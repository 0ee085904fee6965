"""Quality rules as weak supervision: each rule votes or abstains; EM weighs them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm import weak
from korpusflow.llm.common import fresh, stored
from korpusflow.llm.weak import ABSTAIN, BAD, GOOD

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes", "quality", "kept")
WINDOW = 8
_SPACE = b" \t\n\x0b\x0c\r"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKED = re.compile(rb"[#*$%&|<>](?=[\s]|\Z)")
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(slots=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_distinct: int
    n_same: int
    n_upper: int
    n_lower: int
    n_marks: int
    n_marked: int
    n_caps: int
    line_bytes: int
    dup_bytes: int
    n_ended: int


def repeat_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words in windows of 8 words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = hashes.view(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(rolled)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    seen: dict[tuple[bytes, ...], int] = {}
    first = [seen.setdefault(tuple(words[i : i + WINDOW]), i) for i in at.tolist()]  # the words themselves decide
    found, times = np.unique(first, return_counts=True)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    own = at[np.isin(first, found[times > 1])]
    np.add.at(covered, own, 1)
    np.add.at(covered, own + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str) -> Counts:
    data = text.encode()
    words = data.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    distinct, line_bytes = set(lines), sum(map(len, lines))
    return Counts(
        len(words), len(text) - sum(text.count(chr(c)) for c in _SPACE), symbols, len(lines) - len(distinct), repeat_words(words, hashes),
        len(lines), len(np.unique(hashes)), int((hashes[1:] == hashes[:-1]).sum()), len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _UPPER.lower())),
        len(data) - len(data.translate(None, _MARKS)), len(_MARKED.findall(data)) if symbols else 0,
        sum(map(bytes.isupper, words)), line_bytes, line_bytes - sum(map(len, distinct)), sum(x.rstrip().endswith(_ENDS) for x in lines),
    )


def _by(value: float, good: float, bad: float) -> int:
    """Good up to `good`, bad from `bad` on."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def votes(c: Counts) -> list[int]:
    """One vote for each rule.  Some are strict, some rough: what each is worth is learnt."""
    n, mean = c.n_words, c.word_chars / max(1, c.n_words)
    enough = n >= 10
    letters = c.n_upper + c.n_lower
    return [
        GOOD if n >= 50 else BAD if n < 15 else ABSTAIN,
        (GOOD if 4 <= mean <= 6.6 else BAD if mean < 3.6 or mean > 9 else ABSTAIN) if enough else ABSTAIN,
        _by(c.n_symbols / n, 0.02, 0.1) if enough else ABSTAIN,
        _by(c.n_marked / n, 0.02, 0.1) if enough else ABSTAIN,
        _by(c.n_marks / c.word_chars, 0.1, 0.2) if enough else ABSTAIN,
        _by(c.n_dup_lines / c.n_lines, 0.1, 0.4) if c.n_lines >= 3 else ABSTAIN,
        _by(c.n_repeat_words / n, 0.1, 0.3) if enough else ABSTAIN,
        _by(c.n_same / n, 0.05, 0.2) if enough else ABSTAIN,
        _by(-c.n_distinct / n, -0.45, -0.25) if enough else ABSTAIN,
        _by(c.n_upper / letters, 0.2, 0.5) if letters >= 20 else ABSTAIN,
        _by(c.n_caps / n, 0.1, 0.4) if enough else ABSTAIN,
        _by(c.dup_bytes / c.line_bytes, 0.1, 0.4) if c.n_lines >= 3 else ABSTAIN,
        _by(-c.n_ended / c.n_lines, -0.5, -0.1) if c.n_lines >= 3 else ABSTAIN,
    ]


N_RULES = len(votes(Counts(*[0] * 16)))
#: The rules that look for symbols, repeated words, repeated lines, capitals.
KINDS = ((2, 3, 4), (6, 7, 8), (5, 6, 11), (9, 10))


def failed(c: Counts) -> bool:
    return c.n_words < 20 or 100 * c.n_repeat_words > 30 * c.n_words


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes array<int>"


def quality_rules(docs: DataFrame, text_col: str = "text", *, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Adds RESULTS to each row: the counts, base_failed, the votes, quality (posterior probability of a good document), kept.

    keep: the columns to return beside these (default: all).  Columns of docs
    named like a result give way to it.

    kept: not base_failed and quality >= threshold.  A null or empty text has
    no words, so base_failed holds.  Each row is judged by itself, whatever its
    id; rows that repeat are judged alike; an empty table gives no row.  The
    accuracies come from all rows.  Where the texts aren't returned, each is
    read once: what the rules see is written with the columns to return; where
    they are, reading them twice takes less than writing them.  Nothing is
    shuffled but the counts of vote patterns (3 ** N_RULES at most), which
    alone reach the driver.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    seen = fresh("__seen", docs)

    @F.pandas_udf(_COUNTS)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                c = counts(t or "")
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed(c), votes(c)))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes"])

    table = docs.select(*names, judged(F.col(text_col)).alias(seen))
    if text_col not in names:
        table = stored(table, "quality-rules")
    code = F.col(f"{seen}.votes")
    found = table.groupBy(weak.code_column(code, N_RULES).alias("code")).count().collect()
    model = weak.fit(np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.int64), N_RULES, KINDS)
    # one odds sum for each class: the posterior as a column expression
    share, finds = np.log(model.share), model.finds
    z = [sum((F.when(F.get(code, F.lit(j)) == BAD, float(np.log(finds[c, j]))).when(F.get(code, F.lit(j)) == GOOD, float(np.log1p(-finds[c, j]))).otherwise(0.0) for j in range(N_RULES)), F.lit(float(share[c]))) for c in range(len(share))]
    quality = 1 / (1 + sum((F.exp(x - z[0]) for x in z[1:]), F.lit(0.0)))
    out = table.select(*names, *(F.col(f"{seen}.{c}").alias(c) for c in RESULTS[:7]), quality.alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))

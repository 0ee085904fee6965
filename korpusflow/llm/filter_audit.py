"""Filter interaction audit: what each of five filters removes in each order, by first-failure lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.llm.common import batches_of, stored, texts_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: ORDERS as filter numbers, 120 x 5.
_PLACES = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: By failed filters (bit k: filter k) and order: the step that removes the document, from 1, or 0.
FIRST_FAILURE = np.zeros((1 << STEPS, len(ORDERS)), dtype=np.int64)
for _mask in range(1, 1 << STEPS):
    FIRST_FAILURE[_mask] = 1 + np.argmax((_mask >> _PLACES) & 1, axis=1)
FEWEST_WORDS = 100
#: White space that ends a word.
_SPACES = b" \t\n\v\f\r"
_MARKS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A worker keeps the counts of at most so many parts at a time before it passes them on.
PARTS = 256
_PIECE = 1 << 20
SUMS = ("docs", "removed", "failing", "unique_fails", "good_lost", "toxic_lost")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words.  Long texts go piece by piece, so that only distinct words are held."""
    if len(text) <= _PIECE:
        words = text.split()  # bytes.split: space and \\x09-\\x0D
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_failures(text: str) -> int:
    """Bits 0 to 3: fails A (few words), B (few distinct ones), C (many capitals), D (a mark)."""
    own = text.encode()
    words, distinct = word_counts(own)
    capitals = len(own) - len(own.translate(None, _CAPITALS))
    marks = len(own) != len(own.translate(None, _MARKS))
    return (words < FEWEST_WORDS) | (100 * distinct < 80 * words) << 1 | (100 * capitals > 10 * len(text)) << 2 | marks << 3


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, text_key (SHA-256), failures: one narrow row per document, the text stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                texts = texts_of(batch, "text")
                keys = pa.array([hashlib.sha256(x.encode()).digest() for x in texts], pa.binary())
                masks = pa.array([text_failures(x) for x in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, masks], ["id", "part", "text_key", "failures"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, part string, text_key binary, failures int")


def _partial(counts: dict[str, np.ndarray], masks: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The arrays of a worker's parts as rows of (part, order, step)."""
    columns: dict[str, list] = {name: [] for name in ("part", "filter_order", "step", *SUMS)}
    bits = np.arange(1 << STEPS)
    fails_of = np.stack([(bits >> k) & 1 for k in range(STEPS)])
    for part, by_label in counts.items():
        of_mask = masks[part]
        failing, alone = (fails_of @ of_mask)[_PLACES], of_mask[1 << np.arange(STEPS)][_PLACES]
        removed = by_label[:, :, 1:]
        n = len(ORDERS) * STEPS
        columns["part"].append([part] * n)
        columns["filter_order"].append(np.repeat(ORDERS, STEPS))
        columns["step"].append(np.tile(np.arange(1, STEPS + 1), len(ORDERS)))
        for name, x in zip(SUMS, (np.full(n, of_mask.sum()), removed.sum(0), failing, alone, removed[[1, 3]].sum(0), removed[[2, 3]].sum(0)), strict=True):
            columns[name].append(np.asarray(x).ravel())
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(SUMS)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(columns.values(), types, strict=True)], list(columns))


def removals(judged: DataFrame) -> DataFrame:
    """From part, failures (0 to 31), label (bit 0: good, bit 1: toxic): partial sums for each part, order and step.

    FIRST_FAILURE says for a document's failures at which step of each order it
    goes; np.bincount adds these up by label.  A worker passes on one array for
    each part it has met.
    """
    cells = len(ORDERS) * (STEPS + 1)
    shape = (4, len(ORDERS), STEPS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        masks: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in (whole.slice(at, 8192) for at in range(0, whole.num_rows, 8192)):
                part = batch.column(0).dictionary_encode()
                names, code = part.dictionary.to_pylist(), part.indices.to_numpy(zero_copy_only=False)
                failures, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for k, name in enumerate(names):
                    own = code == k
                    at = label[own, None] * cells + np.arange(len(ORDERS)) * (STEPS + 1) + FIRST_FAILURE[failures[own]]
                    found = np.bincount(at.ravel(), minlength=4 * cells).reshape(shape)
                    by_mask = np.bincount(failures[own], minlength=1 << STEPS)
                    if name in counts:
                        counts[name] += found
                        masks[name] += by_mask
                    else:
                        counts[name], masks[name] = found, by_mask
                    if len(counts) >= PARTS:
                        yield _partial(counts, masks)
                        counts, masks = {}, {}
        if counts:
            yield _partial(counts, masks)

    return judged.select("part", F.col("failures").cast("int"), F.col("label").cast("int")).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in SUMS))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the filters A to E and step.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals
    (A-Z) > 10 * code points; D: a character of #$%&*|; E: the text of a smaller
    id, in any part, removed or not.  Words end at white space and keep their
    case.  Counts are of documents of the part: kept after the step, removed at
    it, redundant (fail its filter, but went before), unique_fails (fail no
    other), good_lost and toxic_lost (removed there, by labels' quality and
    toxic), shapley (removed by its filter over all 120 orders, at any step).

    A null text is empty, a null part the empty string.  A document without an
    id fails E never and hides no other; rows that repeat the smallest id of a
    text pass E together.  An id that labels has twice is good or toxic if any of its rows
    says so.  No documents, no rows.

    Which row of equal texts comes first is joined back by (id, text), never by
    text alone, so a text that a third of all rows share is dealt like any
    other.  What a worker passes on is one array of 600 cells for each part.
    """
    rows = stored(_judged(docs, id_col, text_col, part_col), "filter-audit")
    marked = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null and (good or toxic)")
    marked = marked.groupBy("id").agg((F.coalesce(F.max(F.col("good").cast("int")), F.lit(0)) + 2 * F.coalesce(F.max(F.col("toxic").cast("int")), F.lit(0))).alias("label"))
    first = rows.where("id is not null").groupBy("text_key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    # null ids find nothing in either join; the text deals them out
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0)))
    judged = rows.join(first, ["id", "text_key"], "left").join(marked.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    copied = F.col("id").isNotNull() & F.col("first").isNull()
    judged = judged.select("part", (F.col("failures") + F.when(copied, 1 << 4).otherwise(0)).alias("failures"), F.coalesce("label", F.lit(0)).alias("label"))
    key = ["part", "filter_order", "step"]
    sums = removals(judged).groupBy(*key).agg(*(F.sum(name).alias(name) for name in SUMS))
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    by_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.select(
        *key, (F.col("docs") - gone).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(by_filter).alias("shapley")
    )

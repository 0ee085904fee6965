"""Hard-negative mining by bit-sliced integer products."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.llm.common import stored

#: Scaled components are floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score that a negative has at least and at most.
LEAST, MOST = 50, 95
#: Anchors and rows that meet in one cell, about.
ANCHORS, ROWS = 2048, 4096
#: Pairs of a tile.
TILE = 1 << 19
#: A tile goes on pair by pair when no more than this part of it is left.
SPARSE = 0.1
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def bit_planes(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(weight, 0/1 matrix) in two's complement, most significant first: the sum of weight * plane is rows.  The first weight is negative."""
    top = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length()
    yield -(1 << top), rows < 0
    for b in range(top - 1, -1, -1):
        yield 1 << b, (rows >> b & 1).astype(bool)


def kth_of_rows(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; NONE where there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), NONE)


def ranked(group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, higher scores first, then smaller ids; and the rank in the group of each so ordered, from 0."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    return order, np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))


def kth_of_groups(group: np.ndarray, x: np.ndarray, k: int, groups: int) -> np.ndarray:
    order, rank = ranked(group, x, x)
    out = np.full(groups, NONE)
    at = order[rank == k - 1]
    out[group[at]] = x[at]
    return out


class Positives:
    """The rows of highest score for each anchor."""

    slots = 1

    def __init__(self, anchors: int, targets: None = None):
        self.k, self.floor = POSITIVES, np.full((anchors, 1), NONE)

    def dense(self, own: slice, low: np.ndarray, high: np.ndarray, mask: np.ndarray) -> np.ndarray:
        least = np.maximum(kth_of_rows(np.where(mask, low, NONE), self.k), self.floor[own, 0])
        return mask & (high >= least[:, None])

    def sparse(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.maximum(kth_of_groups(i, low, self.k, len(self.floor)), self.floor[:, 0])[i]

    def wanted(self, i: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.ones(len(i), dtype=bool)


class Negatives:
    """For each anchor and each of its positives (scores; NONE: no such positive) the rows of highest score in the range that the positive's score gives."""

    slots = POSITIVES

    def __init__(self, anchors: int, targets: np.ndarray):
        self.k, self.floor = NEGATIVES, np.full((anchors, POSITIVES), NONE)
        there = targets != NONE
        t = np.where(there, targets, 0)
        # 50 p <= 100 n <= 95 p, without products that could leave 64 bits
        whole, rest = np.divmod(t, 100)
        self.least = whole * LEAST - (-(rest * LEAST) // 100)
        self.most = whole * MOST + rest * MOST // 100
        self.least[~there], self.most[~there] = 1, 0
        self.open = self.least <= self.most

    def dense(self, own: slice, low: np.ndarray, high: np.ndarray, mask: np.ndarray) -> np.ndarray:
        keep = np.zeros_like(mask)
        for t in range(self.slots):
            if not self.open[own, t].any():
                continue
            least, most = self.least[own, t][:, None], self.most[own, t][:, None]
            can = mask & (low <= most) & (high >= np.maximum(least, self.floor[own, t][:, None])) & self.open[own, t][:, None]
            sure = can & (low >= least) & (high <= most)
            if sure.any():
                can &= high >= kth_of_rows(np.where(sure, low, NONE), self.k)[:, None]
            keep |= can
        return keep

    def sparse(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(i), dtype=bool)
        for t in range(self.slots):
            least, most = self.least[i, t], self.most[i, t]
            can = (low <= most) & (high >= np.maximum(least, self.floor[i, t])) & self.open[i, t]
            sure = can & (low >= least) & (high <= most)
            keep |= can & (high >= kth_of_groups(i[sure], low[sure], self.k, len(self.floor))[i])
        return keep

    def wanted(self, i: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for t in range(self.slots):
            yield t, self.open[i, t] & (score >= self.least[i, t]) & (score <= self.most[i, t])


def survivors(anchors: np.ndarray, planes: list, mask: np.ndarray, own: slice, search: Positives | Negatives) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs of a tile that the search doesn't drop on the way.

    After each plane a score lies between known + rest * down and known + rest *
    up: the smaller bits add at most all of the anchor's components above zero
    and take away at most those below.  Pairs whose interval can't qualify any
    more go; when few are left, the further planes are worked out for these only.
    """
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    a = anchors.astype(planes[0][1].dtype)
    known, i, j = np.zeros(mask.shape, dtype=np.int64), None, None
    for weight, plane in planes:
        rest = abs(weight) - 1
        if i is None:
            known += (a @ plane.T).astype(np.int64) * weight
            if ((rest * (up - down)) < np.ptp(known, axis=1)).any() or not rest:  # wider intervals than that tell nothing apart
                mask = search.dense(own, known + (rest * down)[:, None], known + (rest * up)[:, None], mask)
                if np.count_nonzero(mask) <= SPARSE * mask.size:
                    i, j = np.nonzero(mask)
                    known = known[i, j]
        else:
            for at in range(0, len(i), 1 << 15):
                part = slice(at, at + (1 << 15))
                known[part] += (a[i[part]] * plane[j[part]]).sum(1).astype(np.int64) * weight
            keep = search.sparse(own.start + i, known + rest * down[i], known + rest * up[i])
            i, j, known = i[keep], j[keep], known[keep]
    if i is None:
        i, j = np.nonzero(mask)
        known = known[i, j]
    return i, j, known


class Block:
    """Anchors of one cell and the best rows that they have met so far."""

    def __init__(self, kind: type, uid: np.ndarray, label: np.ndarray, vectors: np.ndarray, targets: np.ndarray | None):
        self.uid, self.label, self.vectors = uid, label, vectors
        self.search = kind(len(uid), targets)
        self.best = [np.empty(0, np.int64) for _ in range(4)]  # group (anchor * slots + slot), score, id, uid

    def meet(self, ids: np.ndarray, uid: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        same = isinstance(self.search, Positives)
        largest = int(np.abs(self.vectors).sum(1).max(initial=0))
        kind = np.float32 if largest < 1 << 24 else np.float64  # sums of so large numbers are exact
        if largest >= 1 << 53:
            kind = np.int64
        width = max(self.vectors.shape[1], vectors.shape[1])
        mine, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.vectors, vectors))
        order = np.argsort(self.label, kind="stable") if same else np.arange(len(mine))
        step = max(1, TILE // max(1, len(rows)))
        planes = [(w, p.astype(kind)) for w, p in bit_planes(rows)]
        for at in range(0, len(order), step):
            # anchors of one label meet its rows only; blocks of anchors are contiguous for the negatives
            own = order[at : at + step]
            for part, cols in ([(own[self.label[own] == x], np.flatnonzero(label == x)) for x in np.unique(self.label[own])] if same else [(own, None)]):
                use = planes if cols is None else [(w, p[cols]) for w, p in planes]
                here_uid, here_label, here_id = (x if cols is None else x[cols] for x in (uid, label, ids))
                mask = (self.label[part][:, None] == here_label) == same
                mask &= self.uid[part][:, None] != here_uid
                if not mask.any():
                    continue
                search = _View(self.search, part)
                i, j, score = survivors(mine[part], use, mask, slice(0, len(part)), search)
                for slot, good in self.search.wanted(part[i], score):
                    self.keep(part[i[good]] * self.search.slots + slot, score[good], here_id[j[good]], here_uid[j[good]])

    def keep(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        if not len(group):
            return
        best = [np.concatenate(x) for x in zip(self.best, (group, score, ids, uid), strict=True)]
        order, rank = ranked(best[0], best[1], best[2])
        at = order[rank < self.search.k]
        self.best = [x[at] for x in best]
        last = order[rank == self.search.k - 1]
        self.search.floor.reshape(-1)[best[0][last]] = best[1][last]


class _View:
    """A search over some of its anchors."""

    def __init__(self, search: Positives | Negatives, own: np.ndarray):
        self.whole, self.own = search, own
        self.part = object.__new__(type(search))
        self.part.__dict__ = {name: x[own] if isinstance(x, np.ndarray) else x for name, x in search.__dict__.items()}
        self.dense, self.sparse = self.part.dense, self.part.sparse


def _ints(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as a matrix, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _mine(cells: DataFrame, kind: type) -> DataFrame:
    """From rows dealt by cell, its anchors first: (anchor uid, slot, score, id, uid) of the best of each cell."""

    def out(block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is not None and len(block.best[0]):
            group, score, ids, uid = block.best
            anchor = block.uid[group // block.search.slots]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, group % block.search.slots, score, ids, uid)], ["anchor", "slot", "score", "id", "uid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cell, waiting = None, None, []
        for whole in batches:
            a, g, is_row, uid, ids, label = (whole.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            turns = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (g[1:] != g[:-1]) | (is_row[1:] != is_row[:-1])]) if len(a) else []
            for at, end in zip(turns, np.r_[turns[1:], len(a)].astype(int), strict=True) if len(a) else []:
                part = (uid[at:end], label[at:end], _ints(whole.column(6).slice(at, end - at)), whole.column(7).slice(at, end - at).to_pylist())
                if not is_row[at]:
                    if cell != (a[at], g[at]):
                        yield from out(block)
                        block, cell, waiting = None, (a[at], g[at]), []
                    waiting.append(part)
                elif cell == (a[at], g[at]):  # rows of a cell without anchors meet nobody
                    if block is None:
                        block, waiting = _block(kind, waiting), []
                    for k in range(at, end, 8192):
                        s = slice(k, min(end, k + 8192))
                        block.meet(ids[s], uid[s], label[s], part[2][k - at : s.stop - at])
        yield from out(block)

    return cells.mapInArrow(run, "anchor long, slot long, score long, id long, uid long")


def _block(kind: type, parts: list) -> Block:
    width = max(p[2].shape[1] for p in parts)
    vectors = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
    targets = None
    if kind is Negatives:
        targets = np.full((len(vectors), POSITIVES), NONE)
        for i, own in enumerate(x for p in parts for x in p[3]):
            targets[i, : len(own or [])] = own or []
    return Block(kind, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), vectors, targets)


def _cells(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """Every group of rows with every group of anchors, each pair of groups in one partition, sorted so that anchors come first."""
    n_rows, n_anchors = counts
    groups, blocks = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(max(n, 1))).cast("int")
    columns = ("uid", "id", "label", "x")
    left = rows.select(dealt(groups).alias("g"), every(blocks).alias("a"), F.lit(True).alias("is_row"), *columns, F.lit(None).cast("array<long>").alias("targets"))
    right = anchors.select(dealt(blocks).alias("a"), every(groups).alias("g"), F.lit(False).alias("is_row"), *columns, "targets")
    both = left.unionByName(right).select("a", "g", "is_row", *columns, "targets")
    return both.repartition(max(groups * blocks, 1), "a", "g").sortWithinPartitions("a", "g", "is_row")


def _scaled(vector: Column, most: int) -> Column:
    return F.transform(vector, lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(v.cast("double") * SCALE).cast("long"))))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Where the id is divisible by 7 the label first becomes (label + 1) % 10.
    Components become floor(256 * x); a score is the integer inner product with
    the anchor.  Anchors are the rows whose id is divisible by 50, against all
    rows.  An anchor's positives are its 5 other rows of the same label with the
    highest scores (ties: smaller ids; all, if fewer); the negatives of each are
    the 3 rows of other labels with the highest scores among those that have at
    least 50 and at most 95 per cent of the positive's (all, if fewer).

    Scores are worked out by the rows' bit-planes, most significant first, in
    tiles: intervals that can't qualify any more drop out after each plane, so
    what is returned is exact.  Rows with a null label, a null vector or a null,
    NaN or infinite component take no part.  A null id is no anchor and comes
    after all others among ties; rows that repeat an id are rows of their own.
    Shorter vectors count as filled up with zeros.  Scaled components are held
    within the root of 2^63 / (2 * the longest dimension), so that each score fits a long: more
    than 100,000,000 for 64 dimensions.  An anchor without positives or a
    positive without negatives gives no row.

    Groups of about 2,048 anchors meet groups of about 4,096 rows in cells of
    their own, dealt by hash, so labels of any size are spread; each cell passes
    on the best of each anchor.
    """
    x = F.col("x")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x")).where(F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 1
    most = isqrt((1 << 62) // max(longest, 1))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), "label", _scaled(x, most).alias("x"))
    rows = stored(rows, "negatives-rows")
    anchor = (F.col("id") % 50 == 0) & (F.col("id") != NO_ID)
    counts = rows.agg(F.count(F.lit(1)), F.count_if(anchor)).first()
    anchors = rows.where(anchor)
    best = lambda df, k, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "uid"))).where(F.col("rank") <= k)
    positives = best(_mine(_cells(rows, anchors.withColumn("targets", F.lit(None).cast("array<long>")), counts), Positives), POSITIVES, "anchor")
    positives = stored(positives.select("anchor", (F.col("rank") - 1).alias("slot"), "score", "id"), "positives")
    targets = positives.groupBy(F.col("anchor").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda p: p["score"]).alias("targets"))
    found = best(_mine(_cells(rows, anchors.join(targets, "uid"), counts), Negatives), NEGATIVES, "anchor", "slot")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        found.select("anchor", "slot", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
        .join(positives.select("anchor", "slot", F.col("id").alias("positive"), F.col("score").alias("positive_score")), ["anchor", "slot"])
        .join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"), "positive_score", "negative_score")
    )

"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import stored
from korpusflow.llm.simhash import _hook, connected

SIMILARITY = 0.98
#: Reference points, no two of them with a cosine of APART or more.
PIVOTS, APART = 256, 0.7
#: Vectors that the reference points are chosen from.
SAMPLE = 2048
#: A vector is described by so many nearest pivots; pairs that share SHARED of them are verified.
NEAREST, SHARED = 10, 5
#: Lists are keyed by as many pivots as brings the mean list below this many members.
LIST = 4096
#: Longer lists are compared in blocks of about so many members, two by two.
BLOCK = 2048
SALTS = 8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, dim: int, n: int = PIVOTS) -> np.ndarray:
    """Up to n directions, from the sample as far as it goes, then random ones of a fixed seed; each APART from all before."""
    drawn = np.random.default_rng(dim).normal(size=(4 * n, dim))
    pool = unit(np.concatenate([sample, drawn]) if len(sample) else drawn)
    chosen = np.empty((0, dim))
    for v in pool:
        if not len(chosen) or (chosen @ v).max() < APART:
            chosen = np.vstack([chosen, v])
            if len(chosen) == n:
                break
    return chosen


def permutations_of(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivots, the nearest first; -1 fills up where there are fewer pivots than NEAREST."""
    k = min(NEAREST, len(pivots))
    out = np.full((len(vectors), NEAREST), -1, dtype=np.int16)
    for at in range(0, len(vectors), 4096):
        out[at : at + 4096, :k] = np.argsort(-(unit(vectors[at : at + 4096]) @ pivots.T), axis=1, kind="stable")[:, :k]
    return out


def least_shared(pivots: int) -> int:
    """SHARED, or all pivots where there are fewer."""
    return min(SHARED, pivots)


def list_keys(own: list[int], depth: int, shared: int) -> list[tuple[int, ...]]:
    """The lists of a vector with these pivots (ascending): two vectors that share `shared` or more meet where the key is the first `depth` they share."""
    return [tuple(own[i] for i in at) for at in combinations(range(len(own)), depth) if all(i <= len(own) - shared + k for k, i in enumerate(at))]


def _incidence(perms: np.ndarray, upto: int) -> np.ndarray:
    """Rows by pivots: 1 where a row has the pivot among its nearest."""
    out = np.zeros((len(perms), upto), dtype=np.float32)
    i, k = np.nonzero((perms >= 0) & (perms < upto))
    out[i, perms[i, k]] = 1
    return out


def linked(perms: np.ndarray, vectors: np.ndarray, other_perms: np.ndarray, other: np.ndarray, key: tuple[int, ...], pivots: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs of two blocks of the list `key` (or of one block), each pair in the one list that is keyed by the first pivots it shares.

    Shared pivots are counted through the inverted lists (incidence products);
    pairs with enough of them are verified by cosine in double precision.
    """
    a, b, least = _incidence(perms, pivots), _incidence(other_perms, pivots), least_shared(pivots)
    last, depth = key[-1] + 1, len(key)
    x, y = unit(vectors), unit(other)
    for at in range(0, len(a), 256):
        end = at + 256
        cand = a[at:end] @ b.T >= least
        cand &= a[at:end, :last] @ b[:, :last].T == depth
        if within:
            cand &= np.arange(at, min(end, len(a)))[:, None] < np.arange(len(b))
        if cand.any():
            i, j = np.nonzero(cand & (x[at:end] @ y.T >= SIMILARITY))
            yield i + at, j


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots_of(sample: list[list[float]]):
    """A function from dimension to its pivots; a dimension that the sample lacks gets random ones."""
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    known = {d: choose_pivots(np.array(vs), d) for d, vs in by_dim.items()}

    def of(d: int) -> np.ndarray:
        if d not in known:
            known[d] = choose_pivots(np.empty((0, d)), d)
        return known[d]

    return of


def _posted(nodes: DataFrame, sample: list[list[float]], depth: int) -> DataFrame:
    """node, n, vector, kind (label and dimension), perm, key, pivots: a row for each list that a vector is in."""
    of = _pivots_of(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.diff(whole.column(2).offsets.to_numpy())
            for d in np.unique(dims):
                rows = whole.take(pa.array(np.flatnonzero(dims == d)))
                pivots = of(int(d))
                shared, deep = least_shared(len(pivots)), min(depth, len(pivots), SHARED)
                for batch in (rows.slice(at, 1024) for at in range(0, rows.num_rows, 1024)):
                    perms = permutations_of(_matrix(batch.column(2)), pivots)
                    take, keys = [], []
                    for i, own in enumerate(perms.tolist()):
                        own = sorted(p for p in own if p >= 0)
                        found = list_keys(own, deep, shared)
                        take += [i] * len(found)
                        keys += found
                    at = pa.array(take, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(at) for k in range(4)), pa.array(list(perms[take]), pa.list_(pa.int16())), pa.array(keys, pa.list_(pa.int32())), pa.array([len(pivots)] * len(take), pa.int32())],
                        ["node", "n", "vector", "kind", "perm", "key", "pivots"],
                    )

    schema = f"node long, n long, vector {nodes.schema['vector'].dataType.simpleString()}, kind string, perm array<smallint>, key array<int>, pivots int"
    return nodes.select("node", "n", "vector", "kind").mapInArrow(run, schema)


def _compare(batch: pa.Table) -> pa.Table:
    """One pair of blocks of one list: (u, v, n): the other vectors that u links to (v null), and a spanning forest (n null)."""
    node, n = batch["node"].to_numpy(), batch["n"].to_numpy()
    block, key, pivots = batch["block"].to_numpy(), tuple(batch["key"][0].as_py()), batch["pivots"][0].as_py()
    vectors, perms = _matrix(batch["vector"]), _matrix(batch["perm"])
    low, high = batch["low"][0].as_py(), batch["high"][0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    links, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    for i, j in linked(perms[left], vectors[left], perms[right], vectors[right], key, pivots, low == high):
        i, j = left[i], right[j]
        links += np.bincount(i, n[j], minlength=len(node)).astype(np.int64) + np.bincount(j, n[i], minlength=len(node)).astype(np.int64)
        _hook(label, i, j)
    some, other = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(node)))
    u = np.concatenate([node[some], node[other]])
    v = pa.array(np.concatenate([np.zeros(len(some), np.int64), node[label[other]]]), pa.int64(), mask=np.arange(len(u)) < len(some))
    count = pa.array(np.concatenate([links[some], np.zeros(len(other), np.int64)]), pa.int64(), mask=np.arange(len(u)) >= len(some))
    return pa.table([pa.array(u, pa.int64()), v, count], names=["u", "v", "n"])


def list_depth(vectors: int, pivots: int = PIVOTS) -> int:
    """The fewest pivots to a key that bring the mean list below LIST members."""
    depth = 1
    while depth < SHARED - 1 and vectors * len(list_keys(list(range(NEAREST)), depth, SHARED)) > LIST * comb(pivots, depth):
        depth += 1
    return depth


def pivot_links(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """From node (distinct long), n (rows it stands for), vector, kind: stored (u, v, n) as of _compare, over all lists."""
    sample = [r.vector for r in nodes.orderBy(F.xxhash64("node"), "node").select("vector").limit(SAMPLE).collect()]
    depth = depth or list_depth(nodes.groupBy("kind").count().agg(F.max("count")).first()[0] or 0)
    posted = _posted(nodes, sample, depth).withColumn("salt", F.pmod(F.col("node"), F.lit(SALTS)))
    sizes = posted.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = posted.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["kind", "key", "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    return stored(dealt.select("kind", "key", "low", "high", "node", "n", "vector", "perm", "pivots", "block").groupBy("kind", "key", "low", "high").applyInArrow(_compare, "u long, v long, n long"), "pivot-links")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, depth: int | None = None) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable, itself included), kept (id = component_id).

    Rows link if their labels are equal and not null and their vectors' cosine
    in double precision is 0.98 or more.  A vector that is null, empty or zero or holds null,
    NaN or infinite components links with nothing, nor do vectors of different
    lengths.  Rows with the same vector and label are one node, whatever their
    number, and link with one another.  A null id is never the smallest unless alone.

    Each vector is described by its 10 nearest of 256 reference points (chosen
    from a sample of 2,048 distinct vectors, no two alike); inverted lists by pivots give
    pairs that share 5 or more, each counted in one list only; these are
    verified.  Every row is indexed.  Vectors at a cosine of exactly 0.98 share
    5 of 10 in 999 of 1,000 cases or more, nearer ones oftener, so a link may be missed, none is
    invented.  Lists longer than 2,048 are compared block by block in tasks of
    their own; comparisons inside one list of vectors that are all alike but
    not equal grow with the square of their number, rows do not.

    depth: pivots to a list's key; more make shorter lists, and more of them
    for each vector.  By default as many as the number of vectors asks for.
    """
    x = F.col("vector")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    able = F.coalesce(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = own.where(able).select("id", "vector", F.concat_ws(" ", F.col("label").cast("string"), F.size(x).cast("string")).alias("kind"))
    rows = rows.withColumn("h1", F.xxhash64("kind", "vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector", "kind"))
    nodes = rows.groupBy("h1", "h2").agg(F.first("kind").alias("kind"), F.first("vector").alias("vector"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    found = pivot_links(nodes, depth)
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    edges = found.where("v is not null").select("u", "v")
    roots = connected(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = nodes.select("h1", "h2", "node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = rows.select("id", "h1", "h2").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(salted, ["h1", "h2", "salt"]).select("id", "n_links", "component_id")
    out = out.unionByName(own.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Near copies by Jaccard similarity of word shingles: prefix index, verification, components."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import batches_of, discard, give_back, release, stored, texts_of
from korpusflow.llm.simhash import SEED, connected

#: Similarity 0.8, as a fraction: exact in integers.
OVER, UNDER = 4, 5
SHINGLE = 5
#: So many texts, those of the smallest hash, tell which shingles are common; these come last in the order.
DRAWN = 2000
COMMON = 100_000
#: Lists up to this length give all their pairs; longer ones compare sketches first and give a spanning forest of what these allow.
SHORT = 16
#: Longer ones are compared in blocks of about so many members.
BLOCK = 1024
#: Into so many parts a list's members are dealt to learn its length; the shortest has about as many members.
PARTS = 16
#: Logarithms of the bits of a sketch, and of the wide one of a set of more than LARGE shingles, for which the other says little.
BITS, WIDE, LARGE = 10, 14, 1024


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64, sorted; words as SimHash cuts them, fewer than `size` are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), dtype=np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if OVER * max(len(a), len(b)) > UNDER * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which any set as similar has at least one in its own prefix: all but the last 4/5, and one more."""
    if not len(own):
        return own
    if len(common):
        known = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate([own[~known], own[known]])
    return own[: len(own) - (OVER * len(own) + UNDER - 1) // UNDER + 1]


def _common(docs: DataFrame, text_col: str) -> np.ndarray:
    """Any order of shingles finds every pair; one with common shingles last keeps the lists short."""
    if not DRAWN:
        return np.zeros(0, dtype=np.int64)
    share = min(1.0, 1.2 * DRAWN / max(1, docs.count()))
    hashed = docs.select(F.xxhash64(text_col).alias("k"), F.col(text_col).alias("t"))
    few = hashed.where(F.col("k") < int((share - 0.5) * 2**64)) if share < 1 else hashed
    drawn = few.dropDuplicates(["k"]).orderBy("k").limit(DRAWN)
    count = Counter(h for r in drawn.toLocalIterator() if r.t for h in shingles(r.t).tolist())
    return np.sort(np.array([h for h, n in count.most_common(COMMON) if n > 1], dtype=np.int64))


def sketch(own: np.ndarray, bits: int = BITS) -> bytes:
    """For each of 2 ** bits places whether an odd number of the shingles falls there."""
    return np.packbits(np.bincount((own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def folded(wide: bytes) -> bytes:
    """A wide sketch as a narrow one."""
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(wide, dtype=np.uint8)).reshape(1 << BITS, -1), axis=1)).tobytes()


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of each pair differ; of a wide one and a narrow one, as narrow ones."""
    out = np.zeros(len(a), dtype=np.int64)
    pairs = [(x, y) if len(x) == len(y) else (folded(x), y) if len(x) > len(y) else (x, folded(y)) for x, y in zip(a, b, strict=True)]
    for size in {len(x) for x, _ in pairs}:
        at = np.array([k for k, (x, _) in enumerate(pairs) if len(x) == size])
        x, y = (np.frombuffer(b"".join(pairs[k][side] for k in at.tolist()), dtype=np.uint64).reshape(len(at), -1) for side in (0, 1))
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def pairs_of(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray | None = None, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list that can be similar: all whose sizes allow it; with sketches a spanning forest of those that these allow too; with roots all such of different roots.

    Each shingle that only one of two sets has turns one bit, so sketches
    differ in no more bits than sets in shingles, and similar sets differ in a
    ninth of their joint size at most: no similar pair is left out.
    """
    if sketches is None:
        a, b = np.triu_indices(len(nodes), 1)
        fit = OVER * np.maximum(sizes[a], sizes[b]) <= UNDER * np.minimum(sizes[a], sizes[b])
        return nodes[a[fit]], nodes[b[fit]]
    out_a, out_b = [], []
    label = np.arange(len(nodes))
    for k in range(1, len(nodes)):
        fit = OVER * np.maximum(sizes[:k], sizes[k]) <= UNDER * np.minimum(sizes[:k], sizes[k])
        if roots is not None:
            fit &= roots[:k] != roots[k]
        at = np.flatnonzero(fit)
        if len(at):
            bits = np.bitwise_count(sketches[at] ^ sketches[k]).sum(1, dtype=np.int64)
            near = (UNDER + OVER) * bits <= (UNDER - OVER) * (sizes[at] + sizes[k])
            at, bits = at[near], bits[near]
            if roots is None and len(at):  # of each tree that k can touch the nearest member
                order = np.argsort(bits, kind="stable")
                trees, first = np.unique(label[at[order]], return_index=True)
                at = at[order[first]]
                label[: k + 1][np.isin(label[: k + 1], trees)] = trees[0]
                label[k] = trees[0]
        out_a.append(np.full(len(at), nodes[k]))
        out_b.append(nodes[at])
    return np.concatenate(out_a), np.concatenate(out_b)


def _lists(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of one list of more than one member after the other, from batches sorted by the first `keys` columns."""

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(len(c), -1) if name == "sketch" else c.to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns, strict=True)]

    rest: list[list[np.ndarray]] = []  # runs of the last list, which may go on
    for batch in _and_end(batches):
        if batch is not None:
            now = arrays(batch)
            rest.append(now)
            if all(rest[0][k][0] == now[k][-1] for k in range(keys)):
                continue
        elif not rest:
            return
        whole = [np.concatenate(x) for x in zip(*rest, strict=True)]
        starts, ends = _bounds(whole[:keys])
        rest = []
        if batch is not None:
            rest = [[c[starts[-1] :].copy() for c in whole]]
            starts, ends = starts[:-1], ends[:-1]
        more = np.flatnonzero(ends - starts > 1)
        for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            yield [c[s:e] for c in whole]


def _bounds(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start and end."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(new))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """From (h, node, n) sorted by h and node: whole lists of 2 to SHORT members, and longer ones in runs as they come, marked; a node counts once in a list.

    No more than a batch and SHORT members are held, however long a list is.
    """
    rest: list[np.ndarray] = []  # what there is of the last list; of a long one its last member, which is given already
    long = False
    for batch in _and_end(batches):
        if batch is not None:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        elif not rest:
            return
        first, _ = _bounds(rest[:2])
        whole = [c[first] for c in rest]
        starts, ends = _bounds(whole[:1])
        size = ends - starts
        for k in np.flatnonzero((size > 1) & (np.arange(len(size)) < len(size) - (batch is not None))).tolist():
            given = long and k == 0
            yield given or size[k] > SHORT, [c[starts[k] + given : ends[k]] for c in whole]
        if batch is None:
            return
        given = long and len(size) == 1
        long = bool(given or size[-1] > SHORT)
        if long and size[-1] > given:
            yield True, [c[starts[-1] + given :] for c in whole]
        rest = [c[-1 if long else starts[-1] :].copy() for c in whole]


def _gathered(rows: Iterator[tuple[np.ndarray | None, ...]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Whole batches of about 65,536 rows from columns of any length; None stands for a column of nulls."""
    kept: dict[tuple[bool, ...], list[tuple[np.ndarray, ...]]] = {}  # by which columns there are
    n: Counter = Counter()

    def batch(there: tuple[bool, ...]) -> pa.RecordBatch:
        size, columns = n.pop(there), map(np.concatenate, zip(*kept.pop(there), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(next(columns), t) if has else pa.nulls(size, t) for has, t in zip(there, kinds, strict=True)], names)

    for r in rows:
        there = tuple(c is not None for c in r)
        if len(r[0]):
            kept.setdefault(there, []).append(tuple(c for c in r if c is not None))
            n[there] += len(r[0])
            if n[there] >= 1 << 16:
                yield batch(there)
    for there in list(kept):
        yield batch(there)
    give_back()


def _first_lists(posted: DataFrame) -> DataFrame:
    """From posted (h, node, n), one shuffle: the pairs (u, v) of short lists, the members (u, h, n) of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((x[1], None, x[0], x[2]) if long else (*pairs_of(x[1], x[2]), None, None) for long, x in _parted(batches))
        yield from _gathered(found, ["u", "v", "h", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()])

    return posted.repartition("h").sortWithinPartitions("h", "node").mapInArrow(run, "u long, v long, h long, n int")


def _long_lists(posted: DataFrame) -> DataFrame:
    """Candidates (u, v) of long lists (h, node, n, sketch, blocks and, if known, root).

    A list of more than BLOCK members is cut into blocks by node, and every two
    blocks meet in a group of their own, so a group has about twice BLOCK
    members, however long the list is.  Two blocks give only the edges between
    them: with the forests of either they span what the whole list spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, i, j, block, node, *others in _lists(batches, 3):
                if i[0] != j[0] and block[0] == block[-1]:
                    continue  # the other block is empty
                u, v = pairs_of(node, *others)
                if i[0] != j[0]:
                    own = node[block == i[0]]
                    across = np.isin(u, own) != np.isin(v, own)
                    u, v = u[across], v[across]
                yield u, v

        yield from _gathered(found(), ["u", "v"], [pa.int64(), pa.int64()])

    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = posted.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "sketch", *(c for c in posted.columns if c == "root"))
    return met.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "block", "node").mapInArrow(run, "u long, v long").distinct()


def _allowed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches allow the similarity; sketches: node, n, wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole):
                near = (UNDER + OVER) * apart(b.column(2).to_pylist(), b.column(3).to_pylist()) <= (UNDER - OVER) * (b.column(4).to_numpy().astype(np.int64) + b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near)), b.column(1).filter(pa.array(near))], ["u", "v"])

    side = lambda c, x: sketches.select(F.col("node").alias(c), F.col("wide").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    return both.select("u", "v", "sa", "sb", "na", "nb").mapInArrow(run, "u long, v long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that are similar; texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = own = None
        for whole in batches:
            for batch in batches_of(whole):
                u, v, a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "a"), texts_of(batch, "b")
                hit = []
                for k, x in enumerate(u):
                    if x != node:
                        node, own = x, shingles(a[k])
                    if similar(own, shingles(b[k])):
                        hit.append(k)
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in hit]), pa.array([v[k] for k in hit])], ["u", "v"])
        give_back()

    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", more: DataFrame | None = None) -> DataFrame:
    """__row of every row but one of each group; docs has a unique column __row (long) and is stored.

    A group is connected by pairs whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more; the row with the smallest id stays
    (null ids last, then the smallest __row).  Two such sets share a shingle
    among the first fifth of each, in any order of all shingles, so the index
    meets every pair.  Lists of up to SHORT members give all their pairs; longer
    ones only a spanning forest of the pairs that their members' sketches
    allow, and after that the allowed pairs between what is still apart, so a
    large group of copies gives few rows; no task holds a list of more than
    about 2 * BLOCK members.  Each candidate is verified by its
    texts.  Sets are known by 64-bit hashes.
    Texts without words are equal.  more: further links between rows (u, v: __row), that join groups too.
    """
    common = _common(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                sets = [shingles(x) for x in texts_of(batch, "__text")]
                nodes = pa.array([xxhash.xxh64_intdigest(x.tobytes(), seed=SEED) - (1 << 63) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), nodes, pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary()),
                     pa.array([sketch(x, WIDE if len(x) > LARGE else BITS) for x in sets], pa.binary()), pa.array([prefix(x, common) for x in sets], pa.list_(pa.int64()))],
                    ["__row", "node", "n", "sketch", "wide", "prefix"],
                )
        give_back()

    sets = stored(docs.select("__row", F.col(text_col).alias("__text")).mapInArrow(run, "__row long, node long, n int, sketch binary, wide binary, prefix array<long>"), "near-prefixes")
    rows = sets.select("__row", "node")
    posted = sets.select(F.explode("prefix").alias("h"), "node", "n")
    listed = stored(_first_lists(posted), "near-lists")
    first = sets.groupBy("node").agg(F.min("__row").alias("__row"))  # rows of one node have the same sketches
    sketches = sets.join(first, ["node", "__row"], "left_semi").select("node", "n", "sketch", "wide")
    members = listed.where("h is not null").select("h", F.col("u").alias("node"), "n")
    blocks = members.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    # the lengths are dealt over parts of a list by node, so that no list is one key of the join
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).join(blocks, ["h", "part"])
    long = stored(members.join(sketches.select("node", "sketch"), "node").select("h", "node", "n", "sketch", "blocks"), "near-long-lists")
    pairs = stored(_allowed(listed.where("h is null").select("u", "v").unionByName(_long_lists(long)).distinct(), sketches), "near-pairs")
    discard(listed)
    release(docs.sparkSession)
    links = stored(_verified(pairs, _texts(pairs, rows, docs, text_col)), "near-links")
    roots = connected(links, "near-components")
    # what the forests' edges that failed leave open
    open_lists = long.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("h", "node", "n", "sketch", "blocks", F.coalesce("root", "node").alias("root"))
    open_pairs = stored(_allowed(_long_lists(open_lists).join(pairs, ["u", "v"], "left_anti"), sketches), "near-pairs")
    if not open_pairs.isEmpty():
        open_links = stored(_verified(open_pairs, _texts(open_pairs, rows, docs, text_col)), "near-links")
        roots = connected(roots.unionByName(open_links), "near-components")
        discard(open_links)
    discard(open_pairs, long, pairs, links)
    if more is not None:
        node = lambda c: rows.select(F.col("__row").alias(c), F.col("node").alias(f"node_{c}"))
        others = more.join(node("u"), "u").join(node("v"), "v").where("node_u != node_v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
        roots = connected(roots.unionByName(others), "near-components")
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("__row"))
    of = rows.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("__row", F.coalesce("root", "node").alias("root"))
    of = of.join(docs.select("__row", F.col(id_col).alias("id")), "__row").select("root", key.alias("key"))
    kept = of.groupBy("root").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", F.col("least.__row").alias("stays"))
    out = stored(of.join(kept, "root").where(F.col("key.__row") != F.col("stays")).select(F.col("key.__row").alias("__row")), "near-copies")
    discard(sets, roots)
    return out


def _texts(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node, text of one row for each node of the pairs."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # stored, so that its size is known: where it is small, no text is shuffled to find these few
    one = stored(rows.join(nodes, "node").groupBy("node").agg(F.min("__row").alias("__row")), "near-nodes")
    return docs.select("__row", F.col(text_col).alias("text")).join(one, "__row").select("node", "text")

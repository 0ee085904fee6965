"""SimHash near-dedup: byte-position index, shared-byte counts, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import batches_of, discard, release, stored, texts_of

SEED, SHINGLE, MOST_BITS = 42, 3, 3
#: Two fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes.
LEAST_SHARED = 8 - MOST_BITS
#: Of any 5 positions 3 lie in the same half, so pairs of 5 shared bytes meet in one of these 8 lists.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Posting lists up to this length are tallied pair by pair; longer ones are split by two more positions first.
SHORT = 64
#: In lists whose members share 5 bytes, up to this length.
SHORT_5 = 512


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' XXH64 (seed 42), as a signed 64-bit integer; no words: 0."""
    words = text.encode().lower().split()  # bytes.split: space and \\x09-\\x0D; bytes.lower: A-Z
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, fp (signed 64-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x, shingle) for x in texts_of(batch, "__text")], pa.int64())], [id_col, "fp"])

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    """Of a signed 64-bit integer, the bytes at these positions."""
    m = sum(255 << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of places a and b; label leads to the smallest place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while not np.array_equal(again := label[label], label):
            label[:] = again


def components(list_of: np.ndarray, same: tuple[int, ...] = ()) -> np.ndarray:
    """For a posting list of distinct fingerprints: the place of the first member of each one's component.

    Tallies equal positional bytes, retains pairs with LEAST_SHARED or more and
    verifies them.  A long list must share the bytes at 5 positions (`same`);
    then its members differ in 24 bits only, and each is looked up among the
    2,324 others that differ in 1 to 3 of these: linear in the list.
    """
    fps = list_of.astype(np.uint64)
    label = np.arange(len(fps))
    if len(fps) <= SHORT_5 or len(same) < LEAST_SHARED:
        octets = fps.view(np.uint8).reshape(-1, 8)
        for at in range(0, len(fps), 256):
            tally = (octets[at : at + 256, None] == octets[None]).sum(-1, dtype=np.uint8)
            a, b = np.nonzero(tally >= LEAST_SHARED)
            a += at
            near = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= MOST_BITS)
            _hook(label, a[near], b[near])
        return label
    rest = np.zeros(len(fps), dtype=np.int64)
    for k, p in enumerate(q for q in range(8) if q not in same):
        rest |= ((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * k)
    place = np.full(1 << (8 * (8 - len(same))), -1, dtype=np.int32)
    place[rest] = np.arange(len(fps))
    for n in range(1, MOST_BITS + 1):
        for bits in combinations(range(8 * (8 - len(same))), n):
            other = place[rest ^ sum(1 << x for x in bits)]
            there = np.flatnonzero(other >= 0)
            _hook(label, there, other[there])
    return label


def _edges(lists: DataFrame) -> DataFrame:
    """From lists (positions as text, fps array): each member of a component but its smallest, with the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for positions, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(np.asarray(fps.values, dtype=np.int64))
                label = components(own, tuple(map(int, positions)))
                other = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[other])
                b.append(own[label[other]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["u", "v"])

    return lists.mapInArrow(run, "u long, v long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u > v) that connect exactly the fingerprints (column fp, distinct) that links connect.

    A spanning forest of each posting list, not all its pairs: no link is lost
    to any component.  A list is collected if it is short, or if its members
    share 5 bytes, which leaves at most 2 ** 24 different ones.
    """
    text = lambda positions: "".join(map(str, positions))
    posted = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(text(t)).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("key")) for t in TRIPLES))).alias("p")).select("fp", "p.at", "p.key")
    sizes = posted.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = posted.join(sizes, ["at", "key"])
    short = sized.where(F.col("n") <= SHORT).groupBy("at", "key").agg(F.collect_list("fp").alias("fps"))
    more = {t: [tuple(sorted({*t, *two})) for two in combinations([p for p in range(8) if p not in t], 2)] for t in TRIPLES}
    finer = F.array(*(F.when(F.col("at") == text(t), F.array(*(F.struct(F.lit(text(s)).alias("at5"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key5")) for s in more[t]))) for t in TRIPLES))
    long = sized.where(F.col("n") > SHORT).select("fp", F.explode(F.flatten(F.filter(finer, lambda x: x.isNotNull()))).alias("p")).select("fp", "p.at5", "p.key5")
    lists = long.groupBy("at5", "key5").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return _edges(short.select("at", "fps")).unionByName(_edges(lists.select(F.col("at5").alias("at"), "fps"))).distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each node of edges (u, v: integers) but the smallest of its component, with the smallest.

    Large-star and small-star by turns (Kiveris et al. 2014) until nothing
    changes; each round is written to the shared folder, nothing but two
    numbers comes to the driver.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last, edges = edges, stored(small.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
        discard(last)
        release(edges.sparkSession)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Texts are lower-cased (A-Z) and cut at white space; shingles of `shingle`
    words, repeats included; fewer words are one shingle, none (or a null text)
    give fingerprint 0, which links like any other.  Links join fingerprints
    that differ in at most 3 bits.  Rows with equal fingerprints are one node,
    whatever their number; null ids are never the smallest unless alone.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected(links(nodes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(whole, "root").select("fp", "component_id")
    return own.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

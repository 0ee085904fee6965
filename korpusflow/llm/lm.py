"""Scoring texts by a context-tree-weighting model learned from the training part of the corpus."""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import batches_of, discard, give_back, release, stored
from korpusflow.llm.ctw import Top, decision_of, grams, lifted, subtree

DEPTH = 5
#: Subtrees below contexts of so many bytes are evaluated each in one task.
LEAD = 3
#: Bytes of text of one block, and positions that numpy handles at once.
BLOCK, STEP = 8 << 20, 1 << 20
#: Rows that a block, or a unit between blocks and buckets, writes at most for what it asks.
FAN = 128
_END_WORD = b"\xff"  # no UTF-8 text has this byte
_TEXTS, _GRAMS, _WORDS = range(3)


def planes(x: np.ndarray) -> bytes:
    """Integers as one run for each of their bytes: those of small ones are mostly zeros, which compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n[order], at)


class Block:
    """Some texts: the grams and words in them, in an order that is the same whenever it is asked for."""

    def __init__(self, texts: list[bytes], depth: int):
        self.texts, self.depth = texts, depth
        self.data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        self.sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Start and gram keys of STEP positions at a time, whatever the texts' lengths."""
        for at in range(0, len(self.data), STEP):
            before = min(at, self.depth)
            yield at, grams(self.data[at - before : at + STEP], self.depth)[before:]

    def keys(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams, sorted, and how often each stands in a training text."""
        out = np.repeat(held, self.sizes)
        learned, other = np.empty(len(out) - int(out.sum()), dtype=np.uint64), []
        end = 0
        for at, every in self.windows():
            of = out[at : at + STEP]
            other.append(_sorted_counts(every[of])[0])
            own = every[~of]
            learned[end : end + len(own)] = own
            end += len(own)
        known, n = _sorted_counts(learned)
        del learned, out
        asked = np.setdiff1d(np.concatenate(other), known)
        every = np.concatenate([known, asked])
        order = np.argsort(every)
        return every[order], np.concatenate([n, np.zeros(len(asked), np.int64)])[order]

    def distinct(self) -> np.ndarray:
        """The same grams alone."""
        every = np.empty(len(self.data), dtype=np.uint64)
        for at, part in self.windows():
            every[at : at + len(part)] = part
        return _sorted_counts(every)[0]

    def words(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words and the end, as they come; the place of each token among them, text by text, the end last; each text's tokens."""
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        place, end = index.__getitem__, index[_END_WORD]
        every, sizes = array("i"), []
        for text in self.texts:
            before = len(every)
            every.extend(map(place, text.split()))
            every.append(end)
            sizes.append(len(every) - before)
        return list(index), np.frombuffer(every, dtype=np.int32), np.array(sizes, dtype=np.int64)

    def scores(self, keys: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sum of the values of each text's grams."""
        places, out, starts = Table(keys), np.zeros(len(self.texts)), np.cumsum(self.sizes) - self.sizes
        for at, every in self.windows():
            each = value[places.places(every)].astype(np.float64)
            first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(every))
            out[first:last] += np.add.reduceat(each, np.maximum(starts[first:last], at) - at)
        return out


class Levels:
    """The way of questions from blocks to buckets, and of answers back.

    With up to `fan` buckets a block asks each of them.  With more, blocks and
    buckets would make rows by their product; so the bucket's number is read in
    digits to the base `fan`, one for each level.  On level l the questions of
    fan ** l blocks that agree in l digits meet in a unit, which asks each key
    once on the next level.  A unit holds about as much as a block, and each
    writes `fan` rows at most.  On the last level units are the buckets.
    """

    def __init__(self, buckets: int, fan: int = FAN):
        self.levels = 1
        while fan**self.levels < buckets:
            self.levels += 1
        self.fan = max(1, int(buckets ** (1 / self.levels)))
        while self.fan**self.levels < buckets:
            self.fan += 1
        self.buckets = self.fan**self.levels

    def split(self, level: int, source: int, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each unit of the next level that a block (level 0) or unit has keys for: places of these."""
        if not len(keys):
            return
        if level:
            group, digits = divmod(source, self.fan**level)
            group //= self.fan
        else:  # which blocks meet is left to a hash of their numbers
            group, digits = ((source * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33) % self.fan ** (self.levels - 1), 0
        of = bucket_of(keys, self.buckets) // self.fan**level % self.fan
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield group * self.fan ** (level + 1) + digits + int(of[order[a]]) * self.fan**level, order[a:b]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_ASKED = "block long, kind int, bucket long, keys binary, n binary"
_UP = "block long, bucket long, keys binary, n binary"
_ANSWER = "block long, kind int, bucket long, answer binary"


def _deal(block_bytes: int, depth: int, levels: Levels):
    """Blocks of consecutive rows: their texts, compressed, and what they ask for, a row for each unit of the first level."""

    def rows(number: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(table)
        out = [(number, _TEXTS, 0, sink.getvalue().to_pybytes(), b"")]
        held = np.array(table.column("held_out").to_pylist(), dtype=bool)
        block = Block(_lowered(table), depth)
        del table, sink
        keys, n = block.keys(held)
        out += [(number, _GRAMS, b, packed(keys[at]), planes(n[at].astype(np.uint32))) for b, at in levels.split(0, number, keys)]
        words, places, sizes = block.words()
        n = np.bincount(places[np.repeat(~held, sizes)], minlength=len(words)).astype(np.uint32)
        out += [(number, _WORDS, b, b" ".join([words[k] for k in at.tolist()]), planes(n[at])) for b, at in levels.split(0, number, word_hashes(words))]
        del keys, n, block, words, places
        give_back()
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256], strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["block", "kind", "bucket", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 33, [], 0
        for whole in batches:
            for batch in batches_of(whole, min(1 << 20, block_bytes)):
                parts.append(pa.RecordBatch.from_pydict({n: c.take(np.arange(len(c))) for n, c in zip(batch.schema.names, batch.columns, strict=True)}) if batch.num_rows < whole.num_rows else batch)
                size += parts[-1].get_total_buffer_size()
                if size >= block_bytes:
                    yield from rows(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield from rows(number, parts)

    return run


def _lowered(table: pa.Table) -> list[bytes]:
    return [(t or "").encode().lower() for chunk in table.column("__text").chunks for t in chunk.to_pylist()]


def _gram_counts(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([unpacked(x) for x in table.column("keys").to_pylist()]), np.concatenate([unplanes(x, kind) for x in table.column("n").to_pylist()]).astype(np.int64))


def _word_counts(table: pa.Table, kind: type) -> tuple[list[list[bytes]], Counter[bytes]]:
    """The words of each row, and the sums of all."""
    asked, total = [x.split(b" ") for x in table.column("keys").to_pylist()], Counter()
    for words, n in zip(asked, table.column("n").to_pylist(), strict=True):
        for w, c in zip(words, unplanes(n, kind).tolist(), strict=True):
            total[w] += c
    return asked, total


def _kind(level: int) -> type:
    """What counts that come to a level are kept as: those of one block are small."""
    return np.uint32 if level == 1 else np.int64


def _gram_sums(level: int):
    def run(table: pa.Table) -> pa.Table:
        keys, n = _gram_counts(table, _kind(level))
        return pa.table({"key": keys.astype(np.int64), "n": n})

    return run


def _asking(unit: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    give_back()
    return pa.table({"block": pa.array([unit] * len(rows), pa.int64()), "bucket": pa.array([b for b, _, _ in rows], pa.int64()), "keys": pa.array([k for _, k, _ in rows], pa.binary()), "n": pa.array([n for _, _, n in rows], pa.binary())})


def _grams_up(levels: Levels, level: int):
    """What a unit asks on the next level: each gram of its questions once, counts summed."""

    def run(table: pa.Table) -> pa.Table:
        unit = table.column("bucket")[0].as_py()
        keys, n = _gram_counts(table, _kind(level))
        return _asking(unit, [(b, packed(keys[at]), planes(n[at])) for b, at in levels.split(level, unit, keys)])

    return run


def _words_up(levels: Levels, level: int):
    """The same for words, in the order of their bytes."""

    def run(table: pa.Table) -> pa.Table:
        unit, (_, total) = table.column("bucket")[0].as_py(), _word_counts(table, _kind(level))
        words = sorted(total)
        n = np.array([total[w] for w in words], dtype=np.int64)
        return _asking(unit, [(b, b" ".join([words[k] for k in at.tolist()]), planes(n[at])) for b, at in levels.split(level, unit, word_hashes(words))])

    return run


def _answered(asked: pa.Table, kind: int, answers: list[bytes]) -> pa.Table:
    give_back()
    return pa.table({"block": asked.column("block"), "kind": pa.array([kind] * len(answers), pa.int32()), "bucket": asked.column("bucket"), "answer": pa.array(answers, pa.binary())})


def _grams_down(levels: Levels, level: int):
    """Passes on to those that asked a unit what it was answered itself."""

    def run(asked: pa.Table, above: pa.Table) -> pa.Table:
        unit, rows = asked.column("bucket")[0].as_py(), [unpacked(x) for x in asked.column("keys").to_pylist()]
        got, keys = dict(zip(above.column("bucket").to_pylist(), above.column("answer").to_pylist(), strict=True)), np.unique(np.concatenate(rows))
        value = np.empty(len(keys), dtype=np.float32)
        for b, at in levels.split(level, unit, keys):
            value[at] = np.frombuffer(got[b], dtype=np.float32)
        return _answered(asked, _GRAMS, [value[np.searchsorted(keys, x)].tobytes() for x in rows])

    return run


def _words_down(levels: Levels, level: int):
    def run(asked: pa.Table, above: pa.Table) -> pa.Table:
        unit, rows = asked.column("bucket")[0].as_py(), [x.split(b" ") for x in asked.column("keys").to_pylist()]
        got, words = dict(zip(above.column("bucket").to_pylist(), above.column("answer").to_pylist(), strict=True)), sorted({w for row in rows for w in row})
        count: dict[bytes, int] = {}
        for b, at in levels.split(level, unit, word_hashes(words)):
            count.update(zip([words[k] for k in at.tolist()], unplanes(got[b], np.int64).tolist(), strict=True))
        return _answered(asked, _WORDS, [planes(np.array([count[w] for w in row], dtype=np.int64)) for row in rows])

    return run


def _word_sums(level: int):
    """For each asking block or unit the sums of its words; in a row without one how many tokens and distinct ones were learned."""

    def run(table: pa.Table) -> pa.Table:
        asked, total = _word_counts(table, _kind(level))
        answers = [planes(np.array([total[w] for w in words], dtype=np.int64)) for words in asked]
        m, bucket = len(asked), table.column("bucket")[0].as_py()
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "kind": pa.array([_WORDS] * (m + 1), pa.int32()), "bucket": pa.array([bucket] * (m + 1), pa.int64()),
            "answer": pa.array([*answers, None], pa.binary()), "tokens": pa.array([0] * m + [total.total()], pa.int64()), "distinct": pa.array([0] * m + [sum(c > 0 for c in total.values())], pa.int64()),
        })

    return run


def _by_key(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _nodes(depth: int, lead: int):
    """The nodes of depth `lead` with the weighted probabilities of the trees below."""

    def run(table: pa.Table) -> pa.Table:
        _, (at, decision, zeros, ones, inner) = subtree(*_by_key(table), depth, lead, mix=False)
        return pa.table({"lead": at.astype(np.int64), "decision": decision.astype(np.int32), "zeros": zeros, "ones": ones, "inner": inner})

    return run


def _lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        zeros, ones, inner = (b.column(k).to_numpy() for k in (2, 3, 4))
        weighted, cut, one = lifted(zeros, ones, inner)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weighted), pa.array(cut), pa.array(one)], ["lead", "decision", "zeros", "ones", "inner", "cut", "one"])


def _values(depth: int, lead: int, top: Top, buckets: int):
    """log10 of the probability of each gram's last byte, from the nodes above the subtree too."""

    def run(counts: pa.Table, above: pa.Table) -> pa.Table:
        keys, n = _by_key(counts)
        mixed, _ = subtree(keys, n, depth, lead)
        if lead > 2:
            code = above.column("lead").to_numpy() << 8 | above.column("decision").to_numpy()
            order = np.argsort(code)
            code, cut, one = code[order], above.column("cut").to_numpy()[order], above.column("one").to_numpy()[order]
            at, x = (keys >> np.uint64(8 * (depth + 1 - lead))).astype(np.int64) << 8, keys.astype(np.int64) & 255
            for b in range(8):
                decision, own = decision_of(x, b)
                node = np.searchsorted(code, at | decision)
                p = np.where(own, one[node], 1 - one[node])
                mixed[:, b] = cut[node] * p + (1 - cut[node]) * mixed[:, b]
        value = top.log10(keys, mixed, depth).astype(np.float32)
        return pa.table({"bucket": bucket_of(keys, buckets), "key": keys.astype(np.int64), "value": value})

    return run


def _answers(asked: pa.Table, values: pa.Table) -> pa.Table:
    key, value = values.column("key").to_numpy().astype(np.uint64), values.column("value").to_numpy()
    order = np.argsort(key)
    key, value = key[order], value[order]
    found = [value[np.searchsorted(key, unpacked(x))].tobytes() for x in asked.column("keys").to_pylist()]
    return pa.table({"block": asked.column("block"), "kind": pa.array([_GRAMS] * len(found), pa.int32()), "bucket": asked.column("bucket"), "answer": pa.array(found, pa.binary())})


class Table:
    """A hash table from 64-bit keys to places, filled and asked by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        left, self.tries = np.arange(len(keys), dtype=np.int32), 0
        home = self._home(keys)
        while len(left):
            at = (home[left] + self.tries) & self.mask
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            left = left[self.slot[at] != left]
            self.tries += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be there."""
        home = self._home(keys)
        out = self.slot[home]
        left = np.flatnonzero(self.keys[out] != keys)
        for k in range(1, self.tries):
            if not len(left):
                break
            got = self.slot[(home[left] + k) & self.mask]
            out[left] = got
            left = left[self.keys[got] != keys[left]]
        return out


def _scores(id_col: str, depth: int, total: int, distinct: int, levels: Levels):
    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        number = dealt.column("block")[0].as_py()
        table = pa.ipc.open_stream(dealt.column("keys")[0].as_buffer()).read_all()
        block = Block(_lowered(table), depth)
        got = {(k, b): a for k, b, a in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "answer")), strict=True)}
        keys = block.distinct()
        value = np.empty(len(keys), dtype=np.float32)
        for b, at in levels.split(0, number, keys):
            value[at] = np.frombuffer(got[_GRAMS, b], dtype=np.float32)
        score = block.scores(keys, value)
        del keys, value
        words, places, tokens = block.words()
        count = np.empty(len(words), dtype=np.int64)
        for b, at in levels.split(0, number, word_hashes(words)):
            count[at] = unplanes(got[_WORDS, b], np.int64)
        starts = np.cumsum(tokens) - tokens
        base = np.add.reduceat(np.log10((count + 1) / (total + distinct + 1))[places], starts)
        known = np.add.reduceat((count > 0).astype(np.int64)[places], starts)
        size = block.sizes
        del block, words, places, got
        give_back()
        return pa.table({
            id_col: table.column("id"), "held_out": table.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([total] * len(size), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score), "bits_per_byte": pa.array(-score / math.log10(2) / size),
        })

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, depth: int = DEPTH, block_bytes: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose crc32(id as text) mod 7 is 2 are held out; the model and the
    counts of the base come from all others (a null id reads as the empty
    text).  score is the log10 probability of the text's bytes after
    lower-casing A-Z and of its end; bits_per_byte is the code length by that
    score for each byte, the end counted as one.  Null texts are empty; rows
    that repeat are scored and learned from each; an empty table gives no row.

    How it spreads: consecutive rows of about block_bytes are a block, written
    with its texts (compressed) and with what it asks: each distinct gram of
    depth + 1 bytes and each word, once, with its training count.  Buckets of
    hashes are as many as blocks, so that a bucket's task holds about as much
    as a block's; even the commonest gram is asked once by a block.  Up to
    `fan` buckets are asked by each block; more through units (Levels) that
    gather the questions of many blocks, so that rows are at most fan for each
    block and level and grow with the bytes of text, not with their square.
    Levels are the logarithm of the blocks to the base fan.  Sums by gram are the model's counts; subtrees below
    contexts of LEAD bytes are weighted each in one task; the answers go back
    to the blocks that asked, in the order of asking.  Only sums for the
    decisions after one byte (at most 256 * 255, whatever the corpus) reach
    the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    levels, lead = Levels(max(1, round(size / block_bytes)), fan), min(LEAD, depth)
    parts = max(16, 4 * levels.buckets)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    every = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), text.alias("__text")).mapInArrow(_deal(block_bytes, depth, levels), _ASKED)
    dealt = stored(every, "lm-blocks", "kind")
    texts, asked, words = (dealt.where(F.col("kind") == k) for k in (_TEXTS, _GRAMS, _WORDS))
    asked, words = [asked.select("block", "bucket", "keys", "n")], [words.select("block", "bucket", "keys", "n")]
    for level in range(1, levels.levels):
        asked.append(stored(asked[-1].groupBy("bucket").applyInArrow(_grams_up(levels, level), _UP), "lm-grams"))
        words.append(stored(words[-1].groupBy("bucket").applyInArrow(_words_up(levels, level), _UP), "lm-word-sums"))
    counts = stored(asked[-1].select("bucket", "keys", "n").groupBy("bucket").applyInArrow(_gram_sums(levels.levels), "key long, n long"), "lm-counts")
    known = stored(words[-1].groupBy("bucket").applyInArrow(_word_sums(levels.levels), f"{_ANSWER}, tokens long, distinct long"), "lm-words")
    release(spark)
    total, distinct = known.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    part = lambda column: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    placed = counts.withColumn("part", part(F.shiftright("key", 8 * (depth + 1 - lead))))
    nodes = stored(placed.groupBy("part").applyInArrow(_nodes(depth, lead), "lead long, decision int, zeros long, ones long, inner double"), "lm-nodes")
    sums = lambda df, column: df.groupBy(column, "decision").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("inner").alias("inner"))
    second = nodes.withColumn("cut", F.lit(0.0)).withColumn("one", F.lit(0.0))
    if lead > 2:
        above = sums(nodes, F.shiftright("lead", 8).alias("lead"))
        second = above.mapInArrow(_lift, "lead long, decision int, zeros long, ones long, inner double, cut double, one double")
    second = stored(second, "lm-nodes-2")
    top = sums(second, F.shiftright("lead", 8).alias("last")).collect()
    top = Top(*(np.array([r[k] for r in top]) for k in range(5)))
    above = nodes.select("lead", "decision", F.shiftright("lead", 8).alias("up")).join(second.select(F.col("lead").alias("up"), "decision", "cut", "one"), ["up", "decision"]).select(part(F.col("lead")).alias("part"), "lead", "decision", "cut", "one")
    above = above if lead > 2 else above.where(F.lit(False))
    values = placed.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(_values(depth, lead, top, levels.buckets), "bucket long, key long, value float")
    answers = stored(asked[-1].select("block", "bucket", "keys").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answers, _ANSWER), "lm-answers")
    discard(counts, nodes, second)
    release(spark)
    told = known.where("block is not null").select("block", "kind", "bucket", "answer")
    for level in range(levels.levels - 1, 0, -1):
        above, told_above = answers, told
        answers = stored(asked[level - 1].select("block", "bucket", "keys").groupBy("bucket").cogroup(above.groupBy("block")).applyInArrow(_grams_down(levels, level), _ANSWER), "lm-answers")
        told = stored(words[level - 1].select("block", "bucket", "keys").groupBy("bucket").cogroup(told_above.groupBy("block")).applyInArrow(_words_down(levels, level), _ANSWER), "lm-words")
        discard(above, asked[level], words[level])
    answers = answers.unionByName(told)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.select("block", "keys").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(id_col, depth, int(total), int(distinct), levels), schema)

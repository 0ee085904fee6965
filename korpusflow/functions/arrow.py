"""Tokens of a whole Arrow batch at once, by numpy over its UTF-8 bytes: the same as functions.text.tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
PIECE = 2 << 20

_SEPARATES = np.zeros(256, dtype=bool)
for _first, _last in ((0x00, 0x2C), (0x2E, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _SEPARATES[_first : _last + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def token_array(text: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All tokens of these texts end to end, and how many each text has; null text has none."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    d = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(text) else np.zeros(0, dtype=np.uint8)
    first = offsets - offsets[0]
    if not len(d):
        return pa.array([], pa.string()), np.zeros(len(text), dtype=np.int64)
    word, low = ~_SEPARATES[d], _LOWER[d]
    kept = word
    if d.max() >= 0x80:
        second = np.r_[d[1:], np.uint8(0)]
        third = np.r_[second[1:], np.uint8(0)]
        two = np.flatnonzero((d == 0xC2) | ((d == 0xC3) & ((second == 0x97) | (second == 0xB7))))
        three = np.flatnonzero((d == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third <= 0xB0))))
        for at, size in ((two, 2), (three, 3)):
            for k in range(size):
                word[at + k] = False
        russian = np.flatnonzero((d == 0xD0) & (second >= 0x81) & (second <= 0xAF))
        s = second[russian]
        early, late, yo = russian[(s >= 0x90) & (s < 0xA0)], russian[s >= 0xA0], russian[s == 0x81]
        low[early + 1] += 0x20
        low[late], low[yo] = 0xD1, 0xD1
        low[late + 1] -= 0x20
        low[yo + 1] = 0x91
        accents = np.flatnonzero((d == 0xCC) & (second == 0x81))
        kept = word.copy()
        kept[accents] = kept[accents + 1] = False
    # a token ends where its text does
    edge = np.zeros(len(d) + 1, dtype=bool)
    edge[first] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    before = np.r_[0, np.cumsum(kept)]
    bounds = np.r_[before[starts], before[-1]].astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[kept]))
    return flat, np.diff(np.searchsorted(starts, first))


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows into parts of about so many bytes of this column."""
    for whole in batches:
        sizes = np.asarray(pc.binary_length(whole.column(column)).fill_null(0)).astype(np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield whole.slice(at, end - at)
            at = end


def counted(flat: pa.StringArray, sizes: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """For texts' words, end to end: each different word of a text once, as the text's place, the word, and how often it stands there."""
    words = flat.dictionary_encode()
    many = max(len(words.dictionary), 1)
    key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + words.indices.to_numpy(), return_counts=True)
    return key // many, words.dictionary.take(pa.array(key % many)), n

"""Packing documents into token windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.bpe import PATTERN, Vocabulary, encoder
from korpusflow.llm.common import batches_of, texts_of

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: Longer texts are encoded by bpe.Encoder, whose time and stack don't depend on how long a run of like characters is.
LONGEST = 1 << 17


class PackEncoder:
    """Encodes texts with the compiled tiktoken library where its rule gives the file's ids: ids in the order of merges."""

    def __init__(self, path: str):
        self.path, self.compiled = path, None
        v = Vocabulary(path)
        order = [k for _, k in sorted((rank, k) for k, (rank, _, _) in v.parts.items())]
        if order == sorted(order) and len(v.ids) == 256 + len(order) and max(v.ids[bytes([b])] for b in range(256)) < min(order, default=1 << 60):
            self.compiled = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.added)

    def encode(self, text: str) -> np.ndarray:
        if self.compiled is None or len(text) > LONGEST:
            return np.frombuffer(encoder(self.path).encode(text), dtype="<u4")
        return self.compiled.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_encoders: dict[str, PackEncoder] = {}


def pack_encoder(path: str) -> PackEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = PackEncoder(path)
    return _encoders[path]


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int


@dataclass
class Packer:
    """Online packing of one stream of documents.

    open[h] holds the partially filled windows at fill level h and count[h]
    their number.  A rest goes to the level (or to a new window) for which the
    sum of count[h] ** 2 afterwards is smallest; of equals, to the fullest.
    """

    window: int = WINDOW
    open: list[list[list[Piece]]] = field(init=False)
    count: np.ndarray = field(init=False)

    def __post_init__(self):
        self.open = [[] for _ in range(self.window)]
        self.count = np.zeros(self.window + 1, dtype=np.int64)

    def level(self, size: int) -> int:
        """The fill level at which to put so many tokens; 0: a new window."""
        n = self.count
        after = n[size:].copy()  # what the level reached has now; index: level left
        after[-1] = -1  # a full window counts nothing: 2 * -1 + 1 stands for the term it doesn't add
        change = 2 * after + 1 - (2 * n[: len(after)] - 1)
        change[0] = 2 * after[0] + 1
        change[-1] += 1
        allowed = n[: len(after)] > 0
        allowed[0] = True
        change[~allowed] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Takes a document; gives the windows that are full now."""
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            yield [Piece(doc, at, ids[at : at + self.window], len(ids))]
        if size := len(ids) - whole:
            piece = Piece(doc, whole, ids[whole:].copy(), len(ids))
            at = self.level(size)
            pieces = []
            if at:
                pieces = self.open[at].pop()
                self.count[at] -= 1
            pieces.append(piece)
            if at + size == self.window:
                yield pieces
            else:
                self.open[at + size].append(pieces)
                self.count[at + size] += 1

    def finish(self) -> Iterator[list[Piece]]:
        """Fills the fullest windows with cuts from the emptiest; the last rest goes into powers of two."""
        left = [pieces for level in self.open for pieces in level]
        self.__post_init__()
        fill = [sum(len(p.ids) for p in pieces) for pieces in left]
        low, high = 0, len(left) - 1
        while low < high:
            need = self.window - fill[high]
            while need and low < high:
                p = left[low].pop()
                if len(p.ids) > need:
                    cut = len(p.ids) - need
                    left[low].append(Piece(p.doc, p.start, p.ids[:cut], p.total))
                    p = Piece(p.doc, p.start + cut, p.ids[cut:], p.total)
                left[high].append(p)
                need -= len(p.ids)
                fill[low] -= len(p.ids)
                if not fill[low]:
                    low += 1
            if not need:
                yield left[high]
                high -= 1
        if left and low == high and fill[low]:
            rest = left[low]
            size = sum(len(p.ids) for p in rest)
            if size == self.window:
                yield rest
                return
            for bit in range(size.bit_length() - 1, -1, -1):
                need, out = size & (1 << bit), []
                while need:
                    p = rest.pop(0)
                    if len(p.ids) > need:
                        rest.insert(0, Piece(p.doc, p.start + need, p.ids[need:], p.total))
                        p = Piece(p.doc, p.start, p.ids[:need], p.total)
                    out.append(p)
                    need -= len(p.ids)
                if out:
                    yield out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids (if asked for), ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then end_id, so an empty or null text is
    one id.  Windows' worth of ids fill windows of their own; the rest of each
    document is placed whole by the sum-of-squares rule.  Each partition packs
    its own rows as they come and needs memory for its open windows only; at
    its end open windows complete each other by cuts, and what is left goes to
    sequences whose lengths are powers of two, so no padding is needed.
    sequence_id is the partition's number times 2 ** 33 plus a count.  Rows
    that repeat an id are documents of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, " + ("ids array<int>, " if ids else "") + "ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, packer, first = pack_encoder(path), Packer(window), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        kind_id, number = None, 0

        def put(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    rows.append((p.doc, p.start, len(p.ids), *((p.ids.astype(np.int32),) if ids else ()), zlib.crc32(p.ids.tobytes()), p.total, first + number, offset))
                    offset += len(p.ids)
                number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            names = [id_col, "start", "length", *(["ids"] if ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, kind_id if k == 0 else pa.list_(pa.int32()) if n == "ids" else pa.int64()) for k, (n, c) in enumerate(zip(names, columns, strict=True))]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for whole in batches:
            kind_id = whole.schema.field(0).type
            for part in batches_of(whole):
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part, "__text"), strict=True):
                    got = np.append(e.encode(text), np.uint32(end_id))
                    put(packer.add(doc, got))
                    if len(rows) >= 5000:
                        yield batch()
        put(packer.finish())
        if rows:
            yield batch()

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)

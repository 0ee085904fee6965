"""Exact byte-level BPE in linear time: backtracking over longest matches.

Two neighbouring tokens can stand side by side in an encoding exactly if BPE
gives these two for their joined bytes.  A sequence whose neighbours are all
compatible is the encoding.  So the encoder takes the longest vocabulary match
at each place, checks it against the token before, and steps back where no
match fits; a bit for each place where an attempt failed keeps this linear.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import batches_of, texts_of

#: The pattern by which the vocabulary's library cuts text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker's caches hold before they start anew.
MOST_CACHED = 300_000
_NONE = -1


def byte_names() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Segments of more characters aren't cached.
LONGEST_CACHED = 64
#: White space other than the space and the line end.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SEGMENT = re.compile(r"\s*\S+|\s+\Z")
#: Characters that are a token of their own at the end of a word of letters.
ENDS = frozenset(".,;:!?")
#: Marks a segment that stands for itself; a text's own are escaped by the slow way.
SELF = "\0"


def segments(text: str) -> list[str]:
    """Cuts text where a space or line end follows a character that isn't white space.

    No token of PATTERN spans such a place and none looks across it, so the
    pieces can be tokenized one by one, and the same piece always alike.  Each
    piece is given as a key: unkeyed() gives its text.
    """
    if not text:
        return []
    if SELF in text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
        return [SELF + x for x in _SEGMENT.findall(text)]
    out = text.replace("\n", " \n").split(" ")  # what follows a space goes without it
    out[0] = SELF + out[0]
    return out


def unkeyed(segment: str) -> str:
    first = segment[:1]
    return segment[1:] if first == SELF else segment if first == "\n" else " " + segment


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        names, model = byte_names(), spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only plain byte-level BPE files are read")
        to_bytes = lambda s: bytes(names[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.added}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        #: (left, right) -> (rank, merged), and merged -> (rank, left, right).
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.merge_table(model["merges"], to_bytes)
        special = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.special = regex.compile(f"({special})") if special else None
        self.words = regex.compile(PATTERN)

    def merge_table(self, merges: list, to_bytes) -> None:
        for rank, m in enumerate(merges):
            a, b = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge.setdefault((i, j), (rank, k))
            self.parts.setdefault(k, (rank, i, j))

    def merged(self, word: bytes) -> list[int]:
        """BPE by its definition: merge the pair of the lowest rank, leftmost first, until none is left."""
        ids = [self.ids[bytes([b])] for b in word]
        while len(ids) > 1:
            best = min((self.merge.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(self.merge[pair][1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids


class Compatible(dict):
    """The pair table: whether two tokens can be neighbours.  Filled as pairs are met.

    Undoing merges from the seam outwards, the later merge first, shows every
    pair that faced each other at the seam; one that would have merged earlier
    than what was undone excludes the two.
    """

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, pair: tuple[int, int]) -> bool:
        good = self.seam(*pair, 1 << 60)
        if len(self) >= MOST_CACHED:
            self.clear()
        self[pair] = good
        return good

    def seam(self, a: int, b: int, limit: int) -> bool:
        """Whether no pair at the seam of a and b merges before those of rank `limit`."""
        v = self.v
        while True:
            rank = v.merge.get((a, b), (1 << 60, 0))[0]
            if rank < limit:
                return False
            ra, rb = v.parts.get(a, (_NONE, 0, 0))[0], v.parts.get(b, (_NONE, 0, 0))[0]
            if ra == _NONE and rb == _NONE:
                return True
            if ra > rb:
                limit, a = ra, v.parts[a][2]
            else:  # of equal ranks the left merge came first; a pair at the seam comes before the right one
                limit, b = rb + 1, v.parts[b][1]


class Encoder:
    """Encodes and decodes whole texts as the vocabulary's library does, special strings included."""

    def __init__(self, path: str):
        self.v = v = Vocabulary(path)
        self.fits = Compatible(v)
        self.trie = ahocorasick.Automaton()
        #: Tokens that merging does give: bytes, and those whose parts do and meet at a seam without an earlier merge.
        self.real = {i for t, i in v.ids.items() if len(t) == 1}
        for k, (rank, i, j) in sorted(v.parts.items(), key=lambda x: x[1]):
            if i in self.real and j in self.real and self.fits.seam(i, j, rank):
                self.real.add(k)
        of = {t: i for t, i in v.ids.items() if i in self.real}
        for t, i in of.items():
            self.trie.add_word(t.decode("latin-1"), (len(t), i))
        self.trie.make_automaton()
        self.whole = of
        self.shorter = {i: next((of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in of), _NONE) for t, i in of.items()}
        self.size = [len(t) for t in v.tokens]
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.line_end, *ends = (array("I", [v.ids[x.encode()]]).tobytes() for x in ("\n", *ENDS))
        self.end_ids = dict(zip(ENDS, ends, strict=True))
        lengths = np.array([len(t) for t in v.tokens], dtype=np.int64)
        #: Decoding: token i is blob[offset[i] : offset[i + 1]].
        self.blob = np.frombuffer(b"".join(v.tokens), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])

    def matches(self, word: bytes) -> list[int]:
        """The longest token that begins at each place, by one pass of the automaton: of one place the later match is the longer."""
        out = [_NONE] * len(word)
        for end, (size, token) in self.trie.iter(word.decode("latin-1")):
            out[end - size + 1] = token
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The longest token at each place that fits the one before; where none does, a step back."""
        if (whole := self.whole.get(word)) is not None:
            return [whole]
        longest, shorter, fits, size = self.matches(word), self.shorter, self.fits, self.size
        token, last, at, n = longest[0], -1, 0, len(word)
        out: list[int] = []
        dead: set[int] = set()
        while True:
            end = at + size[token]
            if (last < 0 or fits[last, token]) and end not in dead:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token == _NONE:  # nothing fits here: this place can't be a seam
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def segment_ids(self, segment: str) -> bytes:
        """A segment's ids; common shapes are put together from shorter segments."""
        if ids := self.before.get(segment):
            self.keep(segment, ids)
            return ids
        if segment.isalpha():
            ids = array("I", self.encode_word(b" " + segment.encode())).tobytes()
        elif segment[-1:] in ENDS and (word := segment[:-1]).isalpha():
            return (self.cache.get(word) or self.segment_ids(word)) + self.end_ids[segment[-1]]
        elif segment[0] == "\n":
            return self.line_end + self.ids(SELF + segment[1:])
        else:
            ids = array("I", [i for word in self.v.words.findall(unkeyed(segment)) for i in self.encode_word(word.encode())]).tobytes()
        self.keep(segment, ids)
        return ids

    def keep(self, segment: str, ids: bytes) -> None:
        """Remembers; when the cache is full, what isn't met again while it fills anew is forgotten."""
        if len(segment) <= LONGEST_CACHED:
            if len(self.cache) >= MOST_CACHED:
                self.before = dict(self.cache)
                self.cache.clear()
            self.cache[segment] = ids

    def ids(self, segment: str) -> bytes:
        return self.cache.get(segment) or self.segment_ids(segment)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        known, make, special = self.cache.get, self.segment_ids, self.v.special
        for k, part in enumerate(special.split(text) if any(x in text for x in self.v.added) else (text,)):
            if k % 2:
                out.append(array("I", [self.v.added[part]]).tobytes())
            else:
                out += [known(x) or make(x) for x in segments(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; what isn't UTF-8 is replaced as the library does."""
        out = []
        every = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(every), 1 << 20):
            i = every[at : at + (1 << 20)].astype(np.int64)
            start, n = self.offset[i], self.offset[i + 1] - self.offset[i]
            ends = np.cumsum(n)
            out.append(self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n)].tobytes())
        whole = b"".join(out)
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            return whole.decode("utf-8", "replace").encode()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = True) -> DataFrame:
    """Per row of docs: id, n_tokens, ids (array of int, if asked for), ids_sha256, decoded_sha256.

    ids: as the tokenizer file's library gives them without added special
    tokens; special strings inside a text become their ids.  ids_sha256 is over
    little-endian unsigned 32-bit integers, decoded_sha256 over the text that
    decoding the ids gives.  A null text is the empty text: no tokens.  Rows are
    independent; nothing is shuffled.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, " + ("ids array<int>, " if ids else "") + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for batch in batches_of(whole):
                n, every, hashed, decoded = [], [], [], []
                for text in texts_of(batch, "__text"):
                    got = e.encode(text)
                    n.append(len(got) // 4)
                    if ids:
                        every.append(np.frombuffer(got, dtype="<i4"))
                    hashed.append(hashlib.sha256(got).hexdigest())
                    decoded.append(hashlib.sha256(e.decode(got)).hexdigest())
                columns = [batch.column(0), pa.array(n, pa.int64()), *([pa.array(every, pa.list_(pa.int32()))] if ids else []), pa.array(hashed), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


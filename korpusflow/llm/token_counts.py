"""Token counts by a compiled finite-state transducer, composed over chunks of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.bpe import ENDS, LONGEST_CACHED, SELF, encoder, segments, unkeyed
from korpusflow.llm.common import batches_of, texts_of

#: Characters of a chunk.
CHUNK = 1 << 16
#: Compiled transitions, and remembered segment counts, that a worker holds before it starts anew.
MOST_STATES, MOST_COUNTS = 150_000, 400_000


class CountTransducer:
    """A deterministic transducer over a word's bytes; transitions emit by how much the token count changes.

    After some bytes of a word the rest of its encoding depends only on the
    places behind which a token could still be running: for each of these the
    node of the vocabulary's trie reached from there, the token that ends
    there, and by how much the count there differs from the present one.  That
    tuple is the state.  A token is at most as long as the longest one of the
    vocabulary, so the states are finitely many; they are compiled as texts
    meet them.
    """

    def __init__(self, path: str):
        e = encoder(path)
        self.fits, self.vocabulary = e.fits, e.v
        self.child: dict[int, int] = {}
        self.token = [-1]
        for t, i in e.whole.items():
            node = 0
            for b in t:
                key = node << 8 | b
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.counts: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.transitions: dict[int, tuple[int, int]] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: next state and change of the count."""
        kept, last, change = [], -1, 0
        for node, before, behind in self.states[state]:
            if to := self.child.get(node << 8 | byte):
                kept.append((to, before, behind))
                token = self.token[to]
                if last < 0 <= token and (before < 0 or self.fits[before, token]):  # one token only can end a prefix's encoding
                    last, change = token, behind + 1
        after = (*((node, before, behind - change) for node, before, behind in kept), (0, last, 0))
        if (n := self.number.get(after)) is None:
            n = self.number[after] = len(self.states)
            self.states.append(after)
        self.transitions[state << 8 | byte] = n, change
        return n, change

    def word(self, word: bytes) -> int:
        state = total = 0
        get = self.transitions.get
        for b in word:
            got = get(state << 8 | b) or self.compile(state, b)
            state = got[0]
            total += got[1]
        return total

    def segment(self, key: str) -> int:
        """Tokens of one segment (see bpe.segments)."""
        if key.isalpha():
            n = self.word(b" " + key.encode())
        elif key[-1:] in ENDS and key[:-1].isalpha():
            n = self.known(key[:-1]) + 1
        elif key[0] == "\n":
            n = 1 + self.known(SELF + key[1:])
        else:
            n = sum(self.word(w.encode()) for w in self.vocabulary.words.findall(unkeyed(key)))
        if len(key) <= LONGEST_CACHED:
            if len(self.counts) >= MOST_COUNTS:
                self.counts.clear()
            self.counts[key] = n
        return n

    def known(self, key: str) -> int:
        n = self.counts.get(key)
        return self.segment(key) if n is None else n

    def text(self, text: str) -> int:
        """Tokens of a text that begins and ends where a token must."""
        known, make, added = self.counts.get, self.segment, self.vocabulary.added
        total = 0
        for k, part in enumerate(self.vocabulary.special.split(text) if any(x in text for x in added) else (text,)):
            if k % 2:
                total += 1
            else:
                for x in segments(part):
                    n = known(x)
                    total += make(x) if n is None else n
        return total


#: Between words: nothing open; a run of letters, digits or other signs; white space, its last character apart (what
#: follows decides whose it is); an apostrophe that may begin a contraction; that and its first letter.
CLOSED, LETTERS, DIGITS, SIGNS, SPACE, APOSTROPHE, CONTRACTION = range(7)
#: Contractions that the pattern cuts off: of one letter, and the second letter of those of two.
ONE_LETTER, SECOND = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}
_KINDS = ((LETTERS, regex.compile(r"\p{L}")), (DIGITS, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))
State = tuple[int, int, str]
START: State = (CLOSED, 0, "")


class Machine:
    """The whole tokenizer as a deterministic transducer over characters: PATTERN's cuts around the words' transducer.

    A state is what is open, the state of its word, and a character that waits.
    Each step emits by how much the count of tokens changes.
    """

    def __init__(self, t: CountTransducer):
        self.t, self.kinds = t, {}

    def kind(self, c: str) -> int:
        if (k := self.kinds.get(c)) is None:
            k = self.kinds[c] = next((k for k, p in _KINDS if p.match(c)), SIGNS)
        return k

    def feed(self, word: int, text: str) -> tuple[int, int]:
        total = 0
        for b in text.encode():
            word, change = self.t.transitions.get(word << 8 | b) or self.t.compile(word, b)
            total += change
        return word, total

    def open(self, c: str, kind: int) -> tuple[State, int]:
        if kind == SPACE:
            return (SPACE, 0, c), 0
        word, n = self.feed(0, c)
        return (APOSTROPHE if c == "'" else kind, word, ""), n

    def step(self, state: State, c: str) -> tuple[State, int]:
        mode, word, waits = state
        kind = self.kind(c)
        if mode == SPACE:
            if kind == SPACE:
                word, n = self.feed(word, waits)
                return (SPACE, word, c), n
            if waits == " ":  # it belongs to what follows
                word, n = self.feed(0, " " + c)
                return (kind, word, ""), n
            alone = self.feed(0, waits)[1]
            state, n = self.open(c, kind)
            return state, alone + n
        if mode == APOSTROPHE:
            if c in ONE_LETTER:
                return START, self.feed(word, c)[1]
            if c in SECOND:
                return (CONTRACTION, word, c), 0
            mode = SIGNS
        elif mode == CONTRACTION:
            if SECOND[waits] == c:
                return START, self.feed(word, waits + c)[1]
            word, n = self.feed(0, waits)
            state, more = self.step((LETTERS, word, ""), c)
            return state, n + more
        if mode == kind:
            word, n = self.feed(word, c)
            return (mode, word, ""), n
        return self.open(c, kind)

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            state, n = self.step(state, c)
            total += n
        return state, total

    def end(self, state: State) -> int:
        """What the end of the text still emits."""
        mode, word, waits = state
        return self.feed(word if mode == SPACE else 0, waits)[1] if waits else 0


class StateMap:
    """What a chunk does to the machine: a table from the state before it to the state behind it and the tokens emitted.

    The states are finitely many; the table holds those that were asked for and
    grows when another is.  Behind the chunk's first seam (a space or line end
    after something else) the state doesn't depend on the one before the chunk:
    from there on the chunk is counted once for all of them.
    """

    def __init__(self, chunk: str, m: Machine):
        self.m, self.table = m, {}
        first = _next_seam(chunk, 1)
        self.head, self.rest = chunk, None
        if first >= 0:
            last = _last_seam(chunk)
            state, n = m.run((SPACE, 0, chunk[last]), chunk[last + 1 :])
            self.head, self.rest = chunk[: first + 1], (state, m.t.text(chunk[first:last]) + n)

    def at(self, state: State) -> tuple[State, int]:
        if (got := self.table.get(state)) is None:
            after, n = self.m.run(state, self.head)
            got = self.table[state] = (after, n) if self.rest is None else (self.rest[0], n + self.rest[1])
        return got

    def then(self, other: StateMap | Composed) -> Composed:
        return Composed(self, other)


class Composed:
    """One chunk's map after another's: a table again.  Composition is associative."""

    def __init__(self, a: StateMap | Composed, b: StateMap | Composed):
        self.a, self.b = a, b
        self.table = {state: self._both(got) for state, got in a.table.items()}

    def _both(self, got: tuple[State, int]) -> tuple[State, int]:
        after, n = self.b.at(got[0])
        return after, got[1] + n

    def at(self, state: State) -> tuple[State, int]:
        if (got := self.table.get(state)) is None:
            got = self.table[state] = self._both(self.a.at(state))
        return got

    then = StateMap.then


def _next_seam(chunk: str, at: int) -> int:
    return next((i for i in range(at, len(chunk)) if chunk[i] in " \n" and not chunk[i - 1].isspace()), -1)


def _last_seam(chunk: str) -> int:
    return next(i for i in range(len(chunk) - 1, 0, -1) if chunk[i] in " \n" and not chunk[i - 1].isspace())


def prefix_scan(maps: list) -> list:
    """All inclusive prefixes, in log2(n) rounds of compositions that don't depend on each other."""
    out, step = list(maps), 1
    while step < len(out):
        out = out[:step] + [out[i - step].then(out[i]) for i in range(step, len(out))]
        step *= 2
    return out


#: Characters before a chunk from which its likeliest state is guessed.
GUESS = 64


def count_tokens(text: str, t: CountTransducer, chunk: int = CHUNK) -> int:
    if len(text) <= chunk:
        return t.text(text)
    m, total = Machine(t), 0
    for k, part in enumerate(t.vocabulary.special.split(text) if any(x in text for x in t.vocabulary.added) else (text,)):
        if k % 2:
            total += 1
        elif part:
            chunks = [part[i : i + chunk] for i in range(0, len(part), chunk)]
            maps = [StateMap(c, m) for c in chunks]
            maps[0].at(START)
            for before, own in zip(chunks, maps[1:], strict=False):  # each by itself: the table's first row is a guess
                own.at(m.run(START, before[-GUESS:])[0])
            state, n = prefix_scan(maps)[-1].at(START)
            total += n + m.end(state)
    return total


_transducers: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    if path not in _transducers:
        _transducers[path] = CountTransducer(path)
    return _transducers[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal those of the tokenizer file's library without added special
    tokens.  A null text is empty: no bytes, no tokens.  Rows are independent;
    nothing is shuffled.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for whole in batches:
            for batch in batches_of(whole):
                n = []
                for text in texts_of(batch, "__text"):
                    if len(t.states) > MOST_STATES:
                        t.restart()
                    n.append(count_tokens(text, t, chunk))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, text.alias("__text"), F.octet_length(text).cast("long").alias("__bytes")).mapInArrow(run, schema)

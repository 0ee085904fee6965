"""Chat formatting: minimum-cost repair of role sequences, then rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import stored

ROLES = ("system", "user", "assistant")
#: States between turns: nothing yet, or the role that spoke last.  A legal dialogue is
#: [system] (user assistant)+, so it begins with system or user and ends with assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
#: Costs: joining a turn to the one before of the same role, taking a turn for another role, an empty turn put in.
MERGE, RELABEL, INSERT = 2, 5, 3
FAR = 1 << 40
#: Bytes of text of one partition.
PART = 32 << 20


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest ways of empty turns from each state to each other: what is put in."""
    out = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), way in list(out.items()):
            for c in LEGAL[b]:
                if (a, c) not in out or len(out[a, c]) > len(way) + 1:
                    out[a, c] = (*way, c)
    return out


PATHS = _paths()


def _options(role: int) -> list[tuple[int, int, int, int, tuple[int, ...]]]:
    """For a turn of this role (0: none of the known): from, to, cost, merged, put in before."""
    out = []
    for target in (SYSTEM, USER, ASSISTANT):
        price = 0 if target == role else RELABEL
        out.append((target, target, price + MERGE, 1, ()))
        for a in range(4):
            for b in range(4):
                if target in LEGAL[b] and (a, b) in PATHS:
                    out.append((a, target, price + INSERT * len(PATHS[a, b]), 0, PATHS[a, b]))
    best: dict[tuple[int, int], tuple] = {}
    for x in sorted(out, key=lambda x: (x[2], x[3], len(x[4]))):
        best.setdefault((x[0], x[1]), x)
    return list(best.values())


OPTIONS = [_options(r) for r in range(4)]
#: Cost of a turn of each role as a matrix over (min, +).
MATRIX = np.full((4, 4, 4), FAR, dtype=np.int64)
for _r in range(4):
    for _a, _b, _c, *_ in OPTIONS[_r]:
        MATRIX[_r, _a, _b] = _c
#: Empty turns that end a dialogue, and what they cost.
ENDING = {s: PATHS.get((s, FINAL)) for s in range(4)}
END_COST = np.array([INSERT * len(ENDING[s]) if ENDING[s] is not None else FAR for s in range(4)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (min, +): the cost of one run after the other."""
    return np.minimum(FAR, (a[:, :, None] + b[None]).min(1))


def run_matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        out = times(out, MATRIX[r])
    return out


def repair(roles: list[int], first: int = START, last: int | None = None) -> list[tuple[int, int, tuple[int, ...]]]:
    """For each turn: role, merged, roles of empty turns put in before it; of least cost.

    first, last: the states before and after; without last the dialogue ends here.
    """
    cost = np.full(4, FAR)
    cost[first] = 0
    back = []
    for r in roles:
        total = cost[:, None] + MATRIX[r]
        back.append(total.argmin(0))
        cost = np.minimum(FAR, total.min(0))
    at = int((cost + END_COST).argmin()) if last is None else last
    out = []
    for r, came in zip(reversed(roles), reversed(back), strict=True):
        a = int(came[at])
        _, _, _, merged, before = next(x for x in OPTIONS[r] if x[0] == a and x[1] == at)
        out.append((at, merged, before))
        at = a
    return out[::-1]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


#: What opens and closes a turn; in a text a backslash keeps these from doing so.
OPENS, CLOSES = "<|im_start|>", "<|im_end|>"


def harmless(text: str) -> str:
    """A text that can't forge a turn: a backslash breaks its markers."""
    return text.replace(OPENS, "<\\|im_start|>").replace(CLOSES, "<\\|im_end|>") if "<|im_" in text else text


def rendered(role: int, merged: int, before: tuple[int, ...], text: str, ending: tuple[int, ...] | None, opened: bool) -> str:
    """The turn's share of the rendered dialogue; shares joined in order are the whole."""
    text = harmless(text)
    out = ["\n" if merged else "<|im_end|>\n" if opened else ""]
    out += [f"<|im_start|>{ROLES[r - 1]}\n<|im_end|>\n" for r in before]
    out += [text] if merged else [f"<|im_start|>{ROLES[role - 1]}\n{text}"]
    if ending is not None:
        out += ["<|im_end|>\n", *(f"<|im_start|>{ROLES[r - 1]}\n<|im_end|>\n" for r in ending)]
    return "".join(out)


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input turn: conv, turn, position, role_in, role, action, inserted_before, inserted_after, segment.

    A dialogue must be [system] (user assistant)+.  Turns are kept ('keep'),
    joined to the turn before ('merge'), taken for another role ('relabel', or
    'merge+relabel'), and empty turns are put in, at least total cost.
    Segments joined by position are the dialogue in ChatML; markers inside a
    text are broken by a backslash, so that no text forges a turn.  Turns are
    ordered by turn number, then role, hash of role and text, and text (nulls
    first), so ties have an order; rows that repeat stay.  Null turns come first, a null conversation is one of
    its own, an unknown or null role is relabelled, a null text is empty.

    Rows are ranged over partitions of about PART bytes by conversation and
    turn, so one long conversation takes many partitions; the pass that weighs
    the ranges reads no texts.  Each gives the cost matrices (4 x 4)
    of the conversations it shares with its neighbours, two at most; these go
    to the driver, which fixes the states at the cuts; then every partition
    repairs its own rows.
    """
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role_in"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("role_in", "text"))
    order = ["conv", "turn", "role_in", "tie", "text"]
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, base.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
    ranged = base.repartitionByRange(n, "conv", "turn", "role_in", "tie").sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "turns")
    again = lambda df: df.repartitionByRange(n, "part").sortWithinPartitions("part", "row")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[dict]]]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                key = (r["part"], r["conv"])
                if key != now and rows:
                    yield *now, rows
                    rows = []
                now = key
                rows.append(r)
        if rows:
            yield *now, rows

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}
        for part, conv, rows in groups(batches):
            m = run_matrix([role_number(r["role_in"]) for r in rows])
            own = out.setdefault(part, [])
            own[1:] = [(part, conv, rows[0]["row"], len(rows), m.ravel().tolist())] if own else []
            if not own:
                own.append((part, conv, rows[0]["row"], len(rows), m.ravel().tolist()))
        rows = [x for own in out.values() for x in own]
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], conv_type), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.list_(pa.int64()))], ["part", "conv", "row", "n", "matrix"])

    from pyspark.sql.pandas.types import to_arrow_type

    conv_kind = turns.schema[conv_col].dataType
    conv_type = to_arrow_type(conv_kind)
    found = sorted(again(kept.select("part", "conv", "role_in", "row")).mapInArrow(edges, f"part int, conv {conv_kind.simpleString()}, row long, n long, matrix array<long>").collect(), key=lambda r: r.row)
    # (part, conv) -> state before, state after (None: the dialogue ends here), position of its first turn
    cuts: dict[tuple[int, object], tuple[int, int | None, int]] = {}
    at = 0
    while at < len(found):
        end = at
        while end + 1 < len(found) and found[end + 1].conv == found[at].conv:
            end += 1
        if end > at:
            ms = [np.array(x.matrix).reshape(4, 4) for x in found[at : end + 1]]
            cost, back = np.where(np.arange(4) == START, 0, FAR), []
            for m in ms:
                total = cost[:, None] + m
                back.append(total.argmin(0))
                cost = np.minimum(FAR, total.min(0))
            state = int((cost + END_COST).argmin())
            states = [state]
            for b in reversed(back):
                state = int(b[state])
                states.append(state)
            states.reverse()
            position = 0
            for k, x in enumerate(found[at : end + 1]):
                cuts[x.part, x.conv] = (states[k], None if at + k == end else states[k + 1], position)
                position += x.n
        at = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            c = list(zip(*out, strict=True))
            out.clear()
            kinds = [conv_type, turn_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["conv", "turn", "position", "role_in", "role", "action", "inserted_before", "inserted_after", "segment"])

        for part, conv, rows in groups(batches):
            first, last, position = cuts.get((part, conv), (START, None, 0))
            roles = [role_number(r["role_in"]) for r in rows]
            for k, (r, number, (role, merged, before)) in enumerate(zip(rows, roles, repair(roles, first, last), strict=True)):
                ends = ENDING[role] if last is None and k == len(rows) - 1 else None
                action = "+".join(x for x in ("merge" if merged else "", "relabel" if role != number else "") if x) or "keep"
                out.append((r["conv"], r["turn"], position + k, r["role_in"], ROLES[role - 1], action, len(before), len(ends or ()), rendered(role, merged, before, r["text"], ends, position + k > 0)))
                if len(out) >= 2000:
                    yield batch()
        if out:
            yield batch()

    turn_kind = turns.schema[turn_col].dataType
    turn_type = to_arrow_type(turn_kind)
    schema = f"conv {conv_kind.simpleString()}, turn {turn_kind.simpleString()}, position long, role_in string, role string, action string, inserted_before int, inserted_after int, segment string"
    return again(kept).mapInArrow(run, schema).withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)

"""Context-tree weighting over bytes: the numerical core, plain numpy.

A byte is coded as eight binary decisions, most significant bit first.  Each
of the 255 decision points has a context tree of its own whose nodes are the
preceding 0..D bytes.  A node holds the Krichevsky-Trofimov estimate of its
zeros and ones; its weighted probability is

    P_w = 1/2 P_kt + 1/2 prod(children's P_w)        (depth D: P_w = P_kt)

and, once the counts are known, the probability of the next bit along a path
is  p_d = a_d kt_d + (1 - a_d) p_{d+1}  with  a_d = (P_kt / 2) / P_w,  the
posterior weight of cutting the tree at that node.  (Willems, Shtarkov,
Tjalkens 1995.)

Grams are unsigned 64-bit integers: the context byte next to the coded byte
is the most significant one, the coded byte is the least significant one, so
that the nodes of depth d are the keys' leading d bytes.
"""

from __future__ import annotations

import numpy as np

#: Coded after the last byte of each text and assumed before the first; no UTF-8 text contains it.
END = 0xFF
_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(1 << 12) + 0.5))])
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 13)))])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; exact to double precision from 1,000 on."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _table(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    small = n < len(table)
    out = table[np.where(small, n, 0)]
    if not small.all():
        out = np.where(small, out, _lgamma(np.maximum(n, len(table)) + shift))
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of any one sequence with so many zeros and ones."""
    return _table(zeros, _HALF, 0.5) + _table(ones, _HALF, 0.5) - np.log(np.pi) - _table(zeros + ones, _FACT, 1.0)


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The key of each position of `data` (texts, END after each); the first text has END before it.

    Context never reaches over an END: bytes before the text count as END.
    """
    n = len(data)
    keys = data.astype(np.uint64)
    ended = np.zeros(n, dtype=bool)
    for d in range(1, depth + 1):
        back = np.full(n, END, dtype=np.uint8)
        back[d:] = data[:-d] if d < n else data[:0]
        ended |= back == END
        back[ended] = END
        keys |= back.astype(np.uint64) << np.uint64(8 * (depth - d + 1))
    return keys


def _level(keys: np.ndarray, counts: np.ndarray):
    """Sums the counts of equal keys: sorted keys, sums, and each input's place among them."""
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64), inverse


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2, mix: bool = True):
    """Evaluates the trees below the nodes of depth `top` that occur in `keys` (distinct, sorted keys).

    counts may be 0: such keys are only asked for.  All keys below a node of
    depth `top` must be given together.  Returns

    * one row of eight probabilities for each key: that of the key's own bit
      at each decision, as mixed from depth `top` downwards (not without `mix`);
    * the decisions' nodes at depth `top`: leading bytes, decision (1..255),
      zeros, ones, log P_w.
    """
    u8, one = np.uint64(8), np.uint64(1)
    levels = {depth: (keys, counts.astype(np.int64), np.arange(len(keys)))}
    for d in range(depth - 1, top - 1, -1):
        above, n, _ = levels[d + 1]
        short = ((above >> np.uint64(16)) << u8) | (above & np.uint64(255)) if d + 1 else above
        unique, sums, inverse = _level(short, n)
        levels[d] = (unique, sums, inverse)
    mixed = np.empty((len(keys) if mix else 0, 8), dtype=np.float64)
    out = []
    for b in range(8):
        rest, bit_at = np.uint64(8 - b), np.uint64(7 - b)
        below = None  # nodes, log P_w of the level below
        prob = None  # for each row of the level below: probability of its bit
        stack = []
        for d in range(depth, top - 1, -1):
            rows, n, _ = levels[d]
            bits = ((rows >> bit_at) & one).astype(bool)
            node_key = ((rows >> u8) << u8) | ((rows & np.uint64(255)) >> rest)
            first = np.flatnonzero(np.concatenate([[True], node_key[1:] != node_key[:-1]])) if len(rows) else np.zeros(0, np.int64)
            node = np.cumsum(np.concatenate([[0], (node_key[1:] != node_key[:-1]).astype(np.int64)])) if len(rows) else np.zeros(0, np.int64)
            nodes = node_key[first]
            ones = np.bincount(node, weights=np.where(bits, n, 0), minlength=len(nodes)).astype(np.int64)
            zeros = np.bincount(node, weights=np.where(bits, 0, n), minlength=len(nodes)).astype(np.int64)
            kt = log_kt(zeros, ones)
            if below is None:
                weighted, cut = kt, None
            else:
                parent = ((below[0] >> np.uint64(16)) << u8) | (below[0] & np.uint64(255))
                inner = np.bincount(np.searchsorted(nodes, parent), weights=below[1], minlength=len(nodes))
                weighted = np.logaddexp(kt, inner) - np.log(2)
                cut = np.exp(kt - np.log(2) - weighted)
            stack.append((node, (ones + 0.5) / (zeros + ones + 1.0) if mix else None, cut))
            below = (nodes, weighted)
        at = np.arange(len(keys))
        for d, (node, one_next, cut) in zip(range(depth, top - 1, -1), stack if mix else [], strict=mix):
            if d < depth:
                at = levels[d][2][at]
            p = one_next[node[at]]
            own = ((keys >> bit_at) & one).astype(bool)
            p = np.where(own, p, 1 - p)
            prob = p if prob is None else cut[node[at]] * p + (1 - cut[node[at]]) * prob
        if mix:
            mixed[:, b] = prob
        rows, n, _ = levels[top]
        nodes, weighted = below
        bits = ((rows >> bit_at) & one).astype(bool)
        node = stack[-1][0]
        out.append((nodes >> u8, (nodes & np.uint64(255)) | np.uint64(1 << b), np.bincount(node, weights=np.where(bits, 0, n), minlength=len(nodes)).astype(np.int64), np.bincount(node, weights=np.where(bits, n, 0), minlength=len(nodes)).astype(np.int64), weighted))
    return mixed, tuple(np.concatenate(x) for x in zip(*out, strict=True))


def lifted(zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes from their children's sums (zeros, ones, log P_w): log P_w, weight of cutting there, probability of a one."""
    kt = log_kt(zeros, ones)
    weighted = np.logaddexp(kt, inner) - np.log(2)
    return weighted, np.exp(kt - np.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1.0)


class Top:
    """The nodes of depth 1 and 0: at most 256 * 255 + 255, whatever the corpus."""

    def __init__(self, last: np.ndarray, decision: np.ndarray, zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray):
        """Sums over depth 2 for each last byte and decision: zeros, ones, log P_w."""
        last, decision = last.astype(np.int64), decision.astype(np.int64)
        z, o, w = (np.zeros((256, 256)) for _ in range(3))
        for to, x in ((z, zeros), (o, ones), (w, inner)):
            np.add.at(to, (last, decision), x)
        z, o = z.astype(np.int64), o.astype(np.int64)
        weighted, self.cut1, self.one1 = lifted(z, o, w)
        _, self.cut0, self.one0 = lifted(z.sum(0), o.sum(0), weighted.sum(0))

    def log10(self, keys: np.ndarray, mixed: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each key's coded byte in its context; mixed: from depth 2 downwards."""
        last = (keys >> np.uint64(8 * depth)).astype(np.int64) & 255
        x = keys.astype(np.int64) & 255
        total = np.zeros(len(keys))
        for b in range(8):
            decision, own = decision_of(x, b)
            p1, p0 = self.one1[last, decision], self.one0[decision]
            p1, p0 = np.where(own, p1, 1 - p1), np.where(own, p0, 1 - p0)
            c1, c0 = self.cut1[last, decision], self.cut0[decision]
            total += np.log10(c0 * p0 + (1 - c0) * (c1 * p1 + (1 - c1) * mixed[:, b]))
        return total


def decision_of(x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The decision that bit b of the bytes x is coded at, and the bit."""
    return (1 << b) | (x >> (8 - b)), (x >> (7 - b)) & 1

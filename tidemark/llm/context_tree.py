"""The context tree of byte contexts: its weights, whole in one table or in parts that are put together. Plain numpy, no Spark."""

from __future__ import annotations

import math

import numpy as np

#: What ends a text, and what stands before its first byte; words never hold it.
END = 10
#: Decisions whose trees are weighted at once.
BLOCK = 8
#: Contexts up to this depth are weighted together; below, each context's subtree is weighted on its own.
TOP = 2


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The code of each byte with the depth bytes before it; data begins with depth bytes of padding."""
    n = len(data) - depth
    code = np.zeros(max(n, 0), np.int64)
    for i in range(depth + 1):
        code = (code << 8) | data[i : i + n]
    return code


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    top = 4096
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(top) + 0.5))])  # ln Gamma(n + 1/2) - ln Gamma(1/2)
    facts = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * top + 1)))])

    def half(n: np.ndarray) -> np.ndarray:
        x = np.maximum(n, top).astype(float)
        return np.where(n < top, table[np.minimum(n, top - 1).astype(np.int64)], (x * np.log(x) - x) + 0.5 * math.log(2) - 1 / (24 * x))  # Stirling

    def fact(n: np.ndarray) -> np.ndarray:
        x = np.maximum(n, 2 * top).astype(float)
        return np.where(n < 2 * top, facts[np.minimum(n, 2 * top - 1).astype(np.int64)], x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x))

    return half(a) + half(b) - fact(a + b)


def newest_first(code: np.ndarray, depth: int) -> np.ndarray:
    """Codes of grams with the context's bytes turned round, so that the contexts with one suffix stand side by side."""
    out = np.zeros(len(code), np.int64)
    for i in range(1, depth + 1):
        out = (out << 8) | ((code >> (8 * i)) & 255)
    return (out << 8) | (code & 255)


def _shorter(rows: np.ndarray) -> np.ndarray:
    """Codes, newest byte first, without the oldest byte of the context."""
    return ((rows >> 16) << 8) | (rows & 255)


def _nodes(rows: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the trees of that bit's decisions, of sorted rows: context and the bits so far, zeros and ones."""
    ids = rows >> (8 - bit)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if not len(ids):
        return ids, n, n
    total, ones = np.add.reduceat(n, first), np.add.reduceat(n * ((rows >> (7 - bit)) & 1), first)
    return ids[first], total - ones, ones


def _up(ids: np.ndarray, bit: int, parents: np.ndarray) -> np.ndarray:
    """Where the node of the same decisions at the shorter context stands."""
    return np.searchsorted(parents, ((ids >> (bit + 8)) << bit) | (ids & ((1 << bit) - 1)))


def _mix(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the weight of the node's own estimate; below is None at leaves."""
    kt = _log_kt(zeros, ones)
    if below is None:
        return kt, np.ones(len(kt))
    mixed = np.logaddexp(kt, below) - math.log(2)
    return mixed, np.exp(kt - math.log(2) - mixed)


class Level:
    """The nodes of one depth and bit: how they predict what no deeper node sees."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray, above: Level | None, bit: int):
        one = (ones + 0.5) / (zeros + ones + 1.0)
        if above is None:
            added, share = np.zeros(len(ids)), np.ones(len(ids))
        else:
            up = _up(ids, bit, above.ids)
            added, share = above.passed[up], above.left[up]
        self.ids = ids
        self.passed, self.left = added + share * weight * one, share * (1 - weight)
        #: At the longest known context; and where longer ones are known, but never stood before this decision.
        self.last, self.deeper = added + share * one, self.passed + self.left * 0.5


class Subtrees:
    """The counts below contexts of depth TOP (all of those that share one), and what they say of grams there.

    The tree holds every context counted, so a node's counts are those of its
    longer contexts, and nodes without counts neither add to a probability nor
    need a place. Weighted over 8 bits and all depths the parts give just what
    ContextTree gives with all contexts.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int):
        if depth <= TOP:
            raise ValueError(f"depth must be over {TOP}")
        self.depth = depth
        rows = newest_first(code[n > 0], depth)
        order = np.argsort(rows)
        self.rows = {depth: (rows[order], n[n > 0][order].astype(float))}
        for d in range(depth - 1, TOP - 1, -1):
            longer, count = self.rows[d + 1]
            short, place = np.unique(_shorter(longer), return_inverse=True)
            self.rows[d] = short, np.bincount(place, weights=count, minlength=len(short))

    def _weighted(self, bit: int) -> tuple[dict, np.ndarray]:
        """By depth, ids, zeros, ones and weights; ln of the weighted probabilities at depth TOP."""
        out, mixed = {}, None
        for d in range(self.depth, TOP - 1, -1):
            ids, zeros, ones = _nodes(*self.rows[d], bit)
            below = None if mixed is None else np.bincount(_up(out[d + 1][0], bit, ids), weights=mixed, minlength=len(ids))
            mixed, weight = _mix(zeros, ones, below)
            out[d] = ids, zeros, ones, weight
        return out, mixed

    def roots(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By bit, what the top of the tree needs: ids, zeros, ones and ln of the weighted probability at depth TOP."""
        out = []
        for bit in range(8):
            nodes, mixed = self._weighted(bit)
            out.append((*nodes[TOP][:3], mixed))
        return out

    def log10(self, code: np.ndarray, top: list[list[Level]]) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others; the grams stand below these contexts."""
        asked, out = newest_first(code, self.depth), np.zeros(len(code))
        known = np.full(len(code), -1)  # the depth of the longest context counted
        for bit in range(8):
            nodes, _ = self._weighted(bit)
            levels = list(top[bit])
            for d in range(TOP + 1, self.depth + 1):
                levels.append(Level(*nodes[d], levels[-1], bit))
            p, open_ = np.full(len(code), 0.5), np.arange(len(code))
            for d in range(self.depth, -1, -1):
                context = asked[open_] >> (8 * (self.depth - d + 1))
                ids, wanted = levels[d].ids, (context << bit) | ((asked[open_] & 255) >> (8 - bit))
                if not len(ids):
                    continue
                i = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
                hit = ids[i] == wanted
                mine, i = open_[hit], i[hit]
                if bit == 0:
                    known[mine] = d  # every context counted has the first decision
                p[mine] = np.where(known[mine] == d, levels[d].last[i], levels[d].deeper[i])
                open_ = open_[~hit]
            p = np.clip(p, 1e-9, 1 - 1e-9)
            out += np.log10(np.where((code >> (7 - bit)) & 1, p, 1 - p))
        return out


def top_levels(bit: int, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, mixed: np.ndarray) -> list[Level]:
    """The levels of depth 0 to TOP, from the roots of all subtrees."""
    order = np.argsort(ids)
    ids, zeros, ones, mixed = ids[order], zeros[order], ones[order], mixed[order]
    # A root's weight follows from its own estimate and its weighted probability.
    steps = [(ids, zeros, ones, np.minimum(np.exp(_log_kt(zeros, ones) - math.log(2) - mixed), 1.0))]
    for _ in range(TOP):
        short, place = np.unique(((ids >> (bit + 8)) << bit) | (ids & ((1 << bit) - 1)), return_inverse=True)
        zeros, ones, below = (np.bincount(place, weights=x, minlength=len(short)) for x in (zeros, ones, mixed))
        ids, (mixed, weight) = short, _mix(zeros, ones, below)
        steps.append((ids, zeros, ones, weight))
    levels: list[Level] = []
    for step in reversed(steps):
        levels.append(Level(*step, levels[-1] if levels else None, bit))
    return levels


class ContextTree:
    """A weighted context tree over the given contexts, and tables that read it in one step per byte.

    ctx_depth, ctx_code: the contexts kept; with a context its suffix without
    the oldest byte and its prefix without the newest must be kept. They are
    sorted by depth, then code, the empty context first. at, byte, count: how
    often a byte followed the context with that index.

    A byte is eight binary decisions; each has its own tree, whose node at a
    context holds zeros and ones counted there. Bottom up, a node's weighted
    probability is half its KT estimate and half the product over its longer
    contexts (with the counts that no longer context kept took as one more
    child, estimated by KT). Top down, that gives the weight of each depth in
    the prediction of the next bit; a context without longer ones is a leaf.
    """

    def __init__(self, ctx_depth: np.ndarray, ctx_code: np.ndarray, at: np.ndarray, byte: np.ndarray, count: np.ndarray):
        n = len(ctx_depth)
        index = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(ctx_depth, ctx_code, strict=True))}
        parent = np.array([index[d - 1, c & ((1 << 8 * (d - 1)) - 1)] if d else 0 for d, c in index], np.int64)
        has = np.zeros(n, bool)
        has[parent[1:]] = True
        levels = [np.flatnonzero(ctx_depth == d) for d in range(int(ctx_depth.max()) + 1)]
        self.log10 = np.zeros((n, 256), np.float32)
        symbols = np.arange(256)
        for first in range(0, 256, BLOCK):  # the trees of different decisions are independent
            one = self._predict(first, n, parent, has, levels, at, byte, count)
            for bit in range(8):
                node = (1 << bit) | (symbols >> (8 - bit))
                here = np.flatnonzero((node >= first) & (node < first + BLOCK))
                if len(here):
                    p = one[:, node[here] - first]
                    self.log10[:, here] += np.log10(np.where((symbols[here] >> (7 - bit)) & 1, p, 1 - p))
        # The automaton: the longest context kept after one more byte.
        self.depth = len(levels) - 1
        self.next = np.zeros((n, 256), np.int32)
        longer: dict[int, list[tuple[int, int]]] = {}
        for (d, c), i in index.items():
            if d:
                longer.setdefault(index[d - 1, c >> 8], []).append((c & 255, i))
        for i in range(n):
            if i:
                self.next[i] = self.next[parent[i]]
            for byte, to in longer.get(i, ()):
                self.next[i, byte] = to

    @staticmethod
    def _predict(first: int, n: int, parent: np.ndarray, has: np.ndarray, levels: list[np.ndarray], at: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability of a one at decisions first, first + 1, ... for every context, mixed over all its depths."""
        zeros, ones = np.zeros((n, BLOCK)), np.zeros((n, BLOCK))
        for bit in range(8):  # decision 1 is the first bit; below decision m are 2m and 2m + 1
            node = (1 << bit) | (byte >> (8 - bit))
            mine = (node >= first) & (node < first + BLOCK)
            if mine.any():
                place, high = at[mine] * BLOCK + node[mine] - first, (byte[mine] >> (7 - bit)) & 1
                zeros += np.bincount(place, weights=count[mine] * (1 - high), minlength=n * BLOCK).reshape(n, BLOCK)
                ones += np.bincount(place, weights=count[mine] * high, minlength=n * BLOCK).reshape(n, BLOCK)
        weight = np.ones((n, BLOCK), np.float32)
        below, rest0, rest1 = np.zeros((n, BLOCK)), zeros.copy(), ones.copy()
        np.subtract.at(rest0, parent[1:], zeros[1:])
        np.subtract.at(rest1, parent[1:], ones[1:])
        for d in range(len(levels) - 1, -1, -1):
            own = levels[d]
            kt, inner = _log_kt(zeros[own], ones[own]), has[own][:, None]
            split = below[own] + _log_kt(np.maximum(rest0[own], 0), np.maximum(rest1[own], 0))
            mixed = np.where(inner, np.logaddexp(kt, split) - math.log(2), kt)
            weight[own] = np.where(inner, np.exp(kt - math.log(2) - mixed), 1.0)
            if d:
                np.add.at(below, parent[own], mixed)
        # What shallower depths add to the prediction at a context, and the share that they leave to it.
        one = (ones + 0.5) / (zeros + ones + 1.0)
        added, share = np.zeros((n, BLOCK)), np.ones((n, BLOCK))
        for own in levels[1:]:
            up = parent[own]
            added[own] = added[up] + share[up] * weight[up] * one[up]
            share[own] = share[up] * (1 - weight[up])
        return np.clip(added + share * one, 1e-9, 1 - 1e-9)

    def score(self, texts: list[bytes], chunk: int = 1024) -> np.ndarray:
        """log10 of the probability of each text and its end. Texts are cut into chunks that advance side by side."""
        depth = self.depth
        pad = bytes([END]) * depth
        parts, owner = [], []
        for k, t in enumerate(texts):
            whole = pad + t + bytes([END])
            for at in range(0, len(whole) - depth, chunk):
                parts.append(whole[at : at + chunk + depth])
                owner.append(k)
        out = np.zeros(len(texts))
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        for first in range(0, len(order), 8192):
            mine = order[first : first + 8192]
            length = np.array([len(parts[i]) for i in mine])
            width = int(length[0])
            block = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in mine), np.uint8).reshape(len(mine), width).T.copy()
            state, total = np.zeros(len(mine), np.int32), np.zeros(len(mine))
            live = np.searchsorted(-length, -np.arange(width), side="left")  # how many chunks are longer than t
            flat_log, flat_next = self.log10.ravel(), self.next.ravel()
            for t in range(width):
                m = live[t]
                at = state[:m].astype(np.int64) * 256 + block[t, :m]
                if t >= depth:
                    total[:m] += flat_log[at]
                state[:m] = flat_next[at]
            np.add.at(out, [owner[i] for i in mine], total)
        return out

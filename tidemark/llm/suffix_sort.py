"""Two-stage suffix sorting of a byte array, to a bounded depth. Plain numpy, no Spark."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts as they do; data has eight bytes to spare."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def smaller_than_next(data: np.ndarray, n: int) -> np.ndarray:
    """Which of the n suffixes are smaller than their successors; the end is smaller than any byte."""
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.sign(data[1:n].astype(np.int16) - data[: n - 1].astype(np.int16))
    # Within a run of one byte the next different byte decides; a run at the end is larger than the end.
    decided = np.flatnonzero(step)
    nearest = np.searchsorted(decided, np.arange(n - 1))
    inside = nearest < len(decided)
    out[: n - 1][inside] = step[decided[nearest[inside]]] > 0
    return out


def sort_directly(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ordered by the depth bytes that follow, eight at a time; only ties go on."""
    order = np.argsort(key := words_at(data, at), kind="stable")
    at, key = at[order], key[order]
    group = np.zeros(len(at), np.int64)
    np.cumsum(key[1:] != key[:-1], out=group[1:]) if len(at) else None
    tied = np.arange(len(at))
    for shift in range(8, depth, 8):
        if not len(tied):
            break
        same = group[tied[1:]] == group[tied[:-1]]
        keep = np.zeros(len(tied), bool)
        keep[1:] |= same
        keep[:-1] |= same
        tied = tied[keep]
        if not len(tied):
            break
        here = at[tied]
        key = words_at(data, here + shift)
        order = np.lexsort((key, group[tied]))
        at[tied], key, old = here[order], key[order], group[tied]
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])])
        # A group's number is its first place, so that numbers stay in order when it splits.
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    return at


def closed(small: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes from begin to end of each stretch, and those that follow up to the first that is smaller than its successor: what the others are induced from."""
    n = len(small)
    direct = np.append(np.flatnonzero(small), n - 1)
    upto = direct[np.minimum(np.searchsorted(direct[:-1], end - 1), len(direct) - 1)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, upto + 1, -1)
    return np.cumsum(edge[:n]) > 0


def suffix_array(data: np.ndarray, depth: int, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of data, ordered by depth bytes at least; only those that start from begin[i] to end[i], and what they need, if these are given.

    Stage one sorts the suffixes that are smaller than their successors
    directly. Stage two scans the buckets of first bytes upwards: the
    predecessor of a suffix in its final place, if it is larger than its
    successor, goes to the next free place at the front of its own bucket. A
    bucket's entries are scanned all at once; only runs of the bucket's own
    byte need another pass each.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    small = smaller_than_next(data, n)
    used = np.ones(n, bool) if begin is None else closed(small, begin, end)
    sizes = np.bincount(data[used], minlength=256)
    out = np.full(sizes.sum(), -1, np.int64)
    start = np.cumsum(sizes) - sizes
    front = start.copy()  # next free place for induced suffixes
    direct = sort_directly(padded, np.flatnonzero(small & used), depth)
    first = data[direct]
    back = start + sizes - np.bincount(first, minlength=256)  # in a bucket the direct ones come last
    for b in np.unique(first):
        mine = direct[first == b]
        out[back[b] : back[b] + len(mine)] = mine
    induced = used & ~small

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[induced[before]]
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        uniq, lo, many = np.unique(byte, return_index=True, return_counts=True)
        for b, i, m in zip(uniq, lo, many, strict=True):
            out[front[b] : front[b] + m] = before[i : i + m]
            front[b] += m

    if used[n - 1]:  # the last suffix is larger than the end, which comes before all
        out[front[data[n - 1]]] = n - 1
        front[data[n - 1]] += 1
    for b in np.flatnonzero(sizes):
        done = start[b]
        while done < front[b]:  # induced ones, and those that they induce in their own bucket
            upto = front[b]
            induce(out[done:upto])
            done = upto
        induce(out[back[b] : start[b] + sizes[b]])
    return out


def common_at_least(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b share their first length bytes; the array must go on that far from both."""
    out = np.zeros(len(a), bool)
    alive = np.arange(len(a))
    shift = 0
    while len(alive) and shift < length:
        if length - shift >= 8:
            same = words_at(data, a[alive] + shift) == words_at(data, b[alive] + shift)
            shift += 8
        else:
            same = data[a[alive] + shift] == data[b[alive] + shift]
            shift += 1
        alive = alive[same]
    out[alive] = True
    return out

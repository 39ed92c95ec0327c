"""Packing token sequences by linear grouping and best fit.

``tokenise`` cuts documents into pieces of at most ``capacity`` tokens.
``plan`` packs the pieces. It works on the histogram of piece lengths, which
has at most ``capacity`` entries however many documents there are, so planning
needs a fixed amount of memory on the driver:

1. Lengths above ``small`` are sorted and cut into ``groups`` groups of equal
   cardinality; within a group every length is rounded up to the longest.
2. A configuration is a multiset of rounded lengths that fits a sequence; as
   ``small`` is a quarter or a third of it, it has three sizes at most. How often
   each is used is optimised: a linear programme takes the fewest sequences that
   hold every group, by the simplex method over all fullest configurations, whose
   slots shorter pieces can take too. Whole parts are used as they stand; of the
   rest the largest fractions are rounded up, as many as the programme's total.
3. Actual pieces replace the rounded ones: a slot takes the longest piece left
   that is no longer than it, a sequence's last slot the longest that fits into
   all the room that rounding has left there.
4. Small pieces, and large ones that no whole configuration took, go by best fit
   decreasing into the room that is left; a new sequence is opened where none fits.

Several numbers of groups and bounds of ``small`` are tried, as all of it works on
the histogram; the plan with the fewest sequences is kept, and of equals the one
whose configurations place the most.

The plan is a list of runs: "pieces of this length with ranks a to b in the
order of their keys go to sequences n, n + 1, ... at this offset". Joining runs
to ranked pieces places every piece without moving texts or ids.

Defined cases: a null or empty text is the closing id alone, one token; a null
doc_id and repeated rows are packed like any other, each row on its own; no
rows give no pieces; input columns other than the id and the text are ignored;
very long texts are cut into pieces of ``capacity``, whole texts are never cut.
Ties: pieces of one length are ranked by doc_id, piece and the ids' checksum;
of equally good plans the first tried is kept.
"""

from __future__ import annotations

import itertools
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, rank_within, require

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Words whose ids a worker keeps at most.
CACHE_WORDS = 400_000


def _byte_alphabet() -> str:
    """The printable character that stands for each byte in byte-level vocabularies, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    places = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}
    return "".join(chr(places[b]) for b in range(256))


class WordIds(dict):
    """Ids of a run of characters without white space, as little-endian bytes; filled by the tokenizer's model on first use."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = tuple(str(t) for t in self.whole.get_added_tokens_decoder().values())
        self.model, self.alphabet = self.whole.model, _byte_alphabet()
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall

    def ids(self, text: str) -> bytes:
        found = [t.id for part in self.parts(text) for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = self.ids(word)
        return out


_WORDS: dict[str, WordIds] = {}


def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    The file's own steps are NFC, lower case and a split into words that never
    hold white space; the ids of a run without white space don't depend on its
    neighbours, so they are looked up once per run. Texts with a special
    token's string go through the library whole.
    """
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    words = _WORDS[path]

    def encode(text: str) -> bytes:
        if any(s in text for s in words.specials):
            found = words.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        plain = text.isascii()
        if not plain:
            # Sigma is lowered without regard to its place in the word, as the library does.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), but not to the tokenizer
            return words.ids(text)
        return b"".join([words[w] for w in text.split()])

    return encode


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless keep_ids)."""
    require(docs, "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality, longest first: (rounded length, [(length, pieces)])."""
    total = sum(counts.values())
    if not total:
        return []
    each = -(-total // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    now: list[tuple[int, int]] = []
    room = each
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, room)
            now.append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append((now[0][0], now))
                now, room = [], each
    if now:
        out.append((now[0][0], now))
    return out


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Fullest multisets of groups that fit a sequence: a row each of group indices, -1 where there is no piece. Sizes fall.

    Of all that share their longer pieces only the one with the longest last
    piece is listed: its last slot can also hold any shorter piece.
    """
    s, n = np.array(sizes), len(sizes)
    most = capacity // sizes[-1]  # pieces in a sequence at most
    first = np.searchsorted(-s, -np.arange(capacity + 1))  # by room, the longest group that fits; n: none
    open_ = np.arange(n)[:, None]
    room = capacity - s
    done = []
    for depth in range(1, most + 1):
        fits = np.maximum(first[room], open_[:, -1])  # never longer than the piece before it
        ends = fits == n
        done.append(np.pad(open_[ends], ((0, 0), (0, most - depth)), constant_values=-1))
        open_, room, fits = open_[~ends], room[~ends], fits[~ends]
        if depth == most or not len(open_):
            break
        if depth == most - 1:
            done.append(np.pad(np.column_stack([open_, fits]), ((0, 0), (0, most - depth - 1)), constant_values=-1))
            break
        times = n - fits  # every group from the longest that fits on
        row = np.repeat(np.arange(len(open_)), times)
        nxt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + fits[row]
        open_, room = np.column_stack([open_[row], nxt]), room[row] - s[nxt]
    alone = np.full((n, most), -1)
    alone[:, 0] = np.arange(n)
    return np.vstack([*done, alone])


def fewest(patterns: np.ndarray, demand: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """How often (fractions too) to use each pattern so that every demand is met with the least total: the revised simplex method.

    A slot can be given to the next shorter group, or be left empty, for nothing.
    The last patterns must be the single groups in order.
    """
    m = len(demand)
    # A little more is asked of every group, by another amount each, so that no step stands still.
    asked = demand + 1e-7 * (1 + np.random.default_rng(5).random(m))
    index = np.where(patterns < 0, m, patterns)

    def column(i: int) -> np.ndarray:
        out = np.zeros(m + 1)
        if i < len(patterns):
            np.add.at(out, index[i], 1)
        else:
            out[i - len(patterns)] = -1
            out[i - len(patterns) + 1] = 1  # the last group's goes to place m, which is nothing
        return out[:m]

    # To begin with, every piece has a sequence of its own.
    basis, cost = np.arange(len(patterns) - m, len(patterns)), np.ones(m)
    inverse, x = np.eye(m), asked.copy()
    for step in range(steps):
        price = np.append(cost @ inverse, 0.0)
        gain = price[index].sum(axis=1) - 1
        slack = price[1:] - price[:-1]
        best, loose = int(np.argmax(gain)), int(np.argmax(slack))
        if max(gain[best], slack[loose]) < 1e-9:
            break
        enter = best if gain[best] >= slack[loose] else len(patterns) + loose
        d = inverse @ column(enter)
        up = np.flatnonzero(d > 1e-10)
        leave = up[int(np.argmin(x[up] / d[up]))]
        basis[leave], cost[leave] = enter, float(enter < len(patterns))
        if step % 100 == 99:
            inverse = np.linalg.inv(np.column_stack([column(i) for i in basis]))
            x = np.maximum(inverse @ asked, 0)
        else:
            row = inverse[leave] / d[leave]
            by = x[leave] / d[leave]
            inverse -= np.outer(d, row)
            inverse[leave] = row
            x = np.maximum(x - by * d, 0)
            x[leave] = by
    used = np.zeros(len(patterns))
    for i, v in zip(basis, x, strict=True):
        if i < len(patterns):
            used[i] += v
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = (32, 128)) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences among some numbers of groups and bounds of what counts as large."""
    tried = [_plan(counts, capacity, g, small) for g, small in itertools.product(groups, sorted({capacity // 4, capacity // 3}))]
    return min(tried, key=lambda t: (max([0, *(seq + n for _, _, n, seq, _ in t[0])]), -t[1]))[0]


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece of the histogram; how many pieces configurations placed.

    Ranks count the pieces of one length from 0; the k-th piece of a run goes
    to the k-th sequence after the first, at the same offset.
    """
    counts = {int(x): int(n) for x, n in counts.items() if n}
    used = dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = placed = 0
    #: Room left: sorted room sizes, and for each the ranges [first sequence, how many).
    rooms: list[int] = []
    ranges: dict[int, list[list[int]]] = {}

    def free(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in ranges:
            insort(rooms, room)
            ranges[room] = []
        ranges[room].append([first, n])

    def take(length: int, first: int, n: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n

    rest = {x: n for x, n in counts.items() if x > small}
    grouped = Counter()
    # So few lengths need no rounding: each is a group.
    for size, members in linear_groups(rest, groups) if len(rest) > groups else [(x, [(x, rest[x])]) for x in sorted(rest, reverse=True)]:
        grouped[size] += sum(n for _, n in members)  # groups that are rounded up to one length are one group
    sizes, have = list(grouped), sorted(rest)

    def place(config: list[int], times: int) -> None:
        """Fills a configuration's slots, each with the longest piece left that fits it; the last slot has all the room that is left."""
        nonlocal sequences, placed
        while times:
            lengths, room = Counter(), capacity
            for k, x in enumerate(config):
                i = bisect_right(have, room if k == len(config) - 1 else min(room, sizes[x])) - 1
                while i >= 0 and rest[have[i]] == lengths[have[i]]:
                    i -= 1
                if i >= 0:
                    lengths[have[i]] += 1
                    room -= have[i]
            if not lengths:
                return
            n = min([times] + [rest[x] // k for x, k in lengths.items()])
            offset = 0
            for x in lengths.elements():
                take(x, sequences, n, offset)
                offset, placed, rest[x] = offset + x, placed + n, rest[x] - n
            have[:] = [x for x in have if rest[x]] if any(not rest[x] for x in lengths) else have
            free(room, sequences, n)
            sequences, times = sequences + n, times - n

    if sizes:
        patterns = configurations(sizes, capacity)
        times = fewest(patterns, np.array(list(grouped.values()), float))
        chosen = [(i, [int(x) for x in patterns[i] if x >= 0]) for i in np.flatnonzero(times > 1e-6)]
        chosen.sort(key=lambda c: (-sum(sizes[x] for x in c[1]), c[1]))
        for i, config in chosen:
            place(config, int(times[i] + 1e-6))
        more = int(np.ceil(times.sum() - 1e-6)) - sequences
        for _, config in sorted(chosen, key=lambda c: -((times[c[0]] + 1e-6) % 1))[: max(0, more)]:
            place(config, 1)

    for length in sorted(counts, reverse=True):
        while n := counts[length] - used[length]:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # open as many as this length would fill
                k = -(-n // (capacity // length))
                take(length, sequences, k, 0)
                free(capacity - length, sequences, k)
                sequences += k
                continue
            room = rooms[i]
            first, m = ranges[room].pop()
            k = min(n, m)
            if k < m:
                ranges[room].append([first, m - k])
            elif not ranges[room]:
                del ranges[room]
                rooms.pop(i)
            take(length, first + m - k, k, capacity - room)
            free(room - length, first + m - k, k)
    return runs, placed


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = (32, 128)) -> DataFrame:
    """Adds sequence_id and offset to pieces; the places in a sequence have no gap and no overlap.

    Pieces of one length are ranked without gathering them in one task.
    """
    total = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in total.collect()}  # at most capacity rows
    if any(x > capacity for x in counts):
        raise ValueError("a piece is longer than a sequence")
    runs = plan(counts, capacity, groups)
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", sum(counts.values()))
    return _place(ranked, runs)


def _place(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Looks up each ranked piece's run; the runs number at most a few per pair of lengths."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, seq, at in sorted(runs):
        by.setdefault(length, []).append((first, seq, at))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {x: np.array(v, np.int64) for x, v in by.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                here, t = length == x, tables[int(x)]
                i = np.searchsorted(t[:, 0], rank[here], side="right") - 1
                seq[here] = t[i, 1] + rank[here] - t[i, 0]
                at[here] = t[i, 2]
            keep = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(seq), pa.array(at)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, groups: tuple[int, ...] = (32, 128), keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. The pieces are written once, so that ids aren't computed twice."""
    return pack(durable(tokenise(docs, tokenizer, capacity, end_id, keep_ids)), capacity, groups)

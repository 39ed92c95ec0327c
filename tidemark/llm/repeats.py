"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else,
in another text or the same one. Suffixes are sorted where repeats can be:

1. Every string of LENGTH bytes has an anchor: the GRAM bytes in it with the
   least hash, the first of equals. Strings with one anchor in a text are
   neighbours; together they are a segment of the text. Equal strings have equal
   anchors, so a segment whose anchor stands nowhere else repeats nothing.
2. Segments with equal bytes are one, with a count; one that stands twice or more
   repeats all its strings.
3. Where an anchor has others beside it, its segments meet in one task, which
   sorts the suffixes of all
   of them in two stages (``suffix_sort``), compares neighbours in that
   order, and marks the starts whose first LENGTH bytes stand there twice,
   counts included. An anchor with more than ``MANY`` different segments would
   not fit a task: the strings of its segments are counted one by one instead,
   by two 64-bit hashes, with partial sums, so that no task gathers them.
4. A segment has one mark, from the first of its starts that repeat to the last:
   it has under LENGTH starts, so two strings of it touch and what they cover is
   one run. The marks go back to every place of a segment; each text is cut once.

Texts are moved once, keyed by two 64-bit hashes: Spark reuses that exchange,
as all that needs texts is one query.
Joins on anchors, segments and texts are followed by an exchange on other keys,
so that Spark can split a key that very many rows share.

Defined cases: a null text is empty; texts of under LENGTH bytes keep everything;
every row is cut, repeated rows too, which repeat each other; null doc_ids are
carried; cuts may fall inside a character: the digest is of the bytes, and the
text that is returned leaves out the halves of such characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, require, with_text_key
from .hashing import Stretches
from .suffix_sort import common_at_least, suffix_array

LENGTH, GRAM = 200, 64
#: Bytes whose anchors are found at once, and that are suffix-sorted at once.
CHUNK, SORTED = 1_000_000, 500_000
#: Different segments of one anchor beyond which their strings are counted one by one.
MANY = 1_000


def anchors(data: np.ndarray) -> np.ndarray:
    """The place of the anchor of the string at each start."""
    width = LENGTH - GRAM + 1
    h = Stretches(data).windows(GRAM)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per segment: the text's place in the list, its first start, the anchor's distance from it, how many starts, the anchor's hash, the bytes' hash."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            piece = t[at : at + CHUNK + LENGTH - 1]
            if len(piece) >= LENGTH:
                held.append((k, at, piece))
                size += len(piece)
            if size >= CHUNK:
                yield _segments(held)
                held, size = [], 0
    if held:
        yield _segments(held)


def _segments(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    begin = np.cumsum(sizes) - sizes
    anchor = anchors(data)
    owner = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= (begin + sizes)[owner])
    a = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[start][1:] != owner[start][:-1])]))
    first = start[new]
    count = np.diff(np.append(new, len(start)))
    place, own = a[new], owner[first]
    h = Stretches(data)
    texts, offset = np.array([k for k, _, _ in held]), np.array([at for _, at, _ in held])
    return texts[own], first - begin[own] + offset[own], place - first, count, h(place, place + GRAM).view(np.int64), h(first, first + count - 1 + LENGTH).view(np.int64)


def repeated_starts(pieces: list[bytes], counts: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its first starts[i] places begin a LENGTH-byte string that stands twice or more among the pieces, each counted counts[i] times."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(data, LENGTH, begin, begin + starts)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    own = owner[order]
    order = order[order - begin[own] < starts[own]]
    own = owner[order]
    same = common_at_least(data, order[1:], order[:-1], LENGTH) if len(order) else np.zeros(0, bool)
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    total = np.bincount(run, weights=counts[own])
    flags = np.zeros(len(data), bool)
    flags[order] = total[run] >= 2
    return [flags[b : b + s] for b, s in zip(begin, starts, strict=True)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at in range(0, batch.num_rows, 500):
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2).slice(at, 500)]
            for text, first, ahead, count, ah, sh in segments(texts):
                row = text + at
                yield pa.RecordBatch.from_arrays([pa.array(ah), pa.array(sh), pa.array(k1[row]), pa.array(k2[row]), pa.array((first << 16) | (ahead << 8) | (count - 1))], names=["ah", "sh", "k1", "k2", "se"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each segment that a text was chosen for. Copies of a text come one after the other; all but a task's first are passed over."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    last = None
    for batch in batches:
        keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
        for key, text, list_ in zip(keys, batch.column("text"), batch.column("list"), strict=True):
            if key == last:
                continue
            last = key
            data = text.as_py().encode("utf-8", "surrogatepass")
            rows = []
            for x in list_.as_py():
                first, count = x["se"] >> 16, (x["se"] & 255) + 1
                rows.append((x["ah"], x["sh"], x["n"], count, data[first : first + count - 1 + LENGTH]))
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000], strict=True), types, strict=True)], names=["ah", "sh", "n", "starts", "bytes"])


def _marks(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["ah", "sh", "a", "b"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: sorted by anchor, of which each has MANY segments at most. Anchors are sorted together up to SORTED bytes.

    A segment can come again where the copies of its text were split over tasks; it counts once.
    """
    held: list[dict] = []
    size, anchor, seen = 0, None, set()

    def flush() -> Iterator[pa.RecordBatch]:
        flags = repeated_starts([x["bytes"] for x in held], np.array([x["n"] for x in held]), np.array([x["starts"] for x in held]))
        rows = [(x["ah"], x["sh"], int(f.argmax()), len(f) - int(f[::-1].argmax())) for x, f in zip(held, flags, strict=True) if x["n"] == 1 and f.any()]
        if rows:
            yield _marks(rows)

    for batch in batches:
        for x in batch.to_pylist():
            if x["ah"] != anchor:
                if size >= SORTED:
                    yield from flush()
                    held, size = [], 0
                anchor, seen = x["ah"], set()
            if x["sh"] in seen:
                continue
            seen.add(x["sh"])
            held.append(x)
            size += len(x["bytes"])
    if held:
        yield from flush()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of LENGTH bytes of the segments, as two 64-bit hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            starts = part.column("starts").to_numpy()
            pieces = part.column("bytes").to_pylist()
            sizes = np.array([len(p) for p in pieces])
            data = np.frombuffer(b"".join(pieces), np.uint8)
            begin, before = np.cumsum(sizes) - sizes, np.cumsum(starts) - starts
            own = np.repeat(np.arange(len(pieces)), starts)
            place = np.arange(len(own)) - before[own]
            first = begin[own] + place
            h1 = Stretches(data).windows(LENGTH)[first]
            h2 = Stretches(data[::-1]).windows(LENGTH)[len(data) - LENGTH - first]
            ah, sh, n = (part.column(c).to_numpy()[own] for c in ("ah", "sh", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n), pa.array(ah), pa.array(sh), pa.array(place.astype(np.int32))], names=["h1", "h2", "n", "ah", "sh", "a"])


def _counted(segments_: DataFrame) -> DataFrame:
    """ah, sh, a, b from the first to the last string that stands twice or more, of segments that stand once, for anchors with too many segments to be sorted in one task."""
    once = segments_.groupBy("ah", "sh").agg(F.first("n").alias("n"), F.first("starts").alias("starts"), F.first("bytes").alias("bytes"))
    once = once.select("ah", "sh", "n", "starts", "bytes")
    kind = "h1 long, h2 long, n long, ah long, sh long, a int"
    twice = once.mapInArrow(_strings, kind).groupBy(F.struct("h1", "h2").alias("h")).agg(F.sum("n").alias("times")).filter("times > 1").select("h.*")
    found = once.filter("n = 1").mapInArrow(_strings, kind).join(twice, ["h1", "h2"])
    return found.groupBy("ah", "sh").agg(F.min("a").alias("a"), (F.max("a") + 1).alias("b"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for a, b in sorted((p["a"], p["b"]) for p in places.as_py() or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True))
            for x, v in zip(out, (kept.decode("utf-8", "ignore"), len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs, each text as it is after removal, with n_bytes, n_removed, n_spans, kept_sha256 (these names are taken from docs if it has them)."""
    require(docs, "text")
    own = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    texts = with_text_key(docs.select(row.alias("row"), text.alias("text"))).select("row", "k1", "k2", "text")
    found = texts.select("k1", "k2", "text").mapInArrow(_find, "ah long, sh long, k1 long, k2 long, se long")
    # Written first: a join of two exchanges lets Spark split an anchor that very many texts share,
    # if what follows is dealt anew; grouping by a struct sees to that.
    twice = durable(found.groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah"))
    places = found.join(twice, "ah").groupBy(F.struct("ah", "sh", "k1", "k2", "se").alias("place")).agg(F.count("*").alias("n"))
    places = durable(places.select("place.*", "n"))
    del found, twice
    release(docs.sparkSession)
    # first() of several columns takes them from one row.
    distinct = places.groupBy("ah", "sh").agg(F.sum("n").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("se").alias("se"))
    distinct = durable(distinct)
    # A segment that stands twice repeats all its strings. Suffixes are sorted for the anchors of those that stand once beside others.
    sure = distinct.filter("n > 1").select("ah", "sh", F.lit(0).alias("a"), (F.col("se").bitwiseAND(255) + 1).cast("int").alias("b"))
    open_ = distinct.groupBy("ah").agg(F.count("*").alias("d"), F.min("n").alias("least")).filter("d > 1 and least = 1").select("ah", (F.col("d") > MANY).alias("many"))
    undecided = durable(distinct.join(durable(open_), "ah"))
    release(docs.sparkSession)

    def bytes_of(part: DataFrame) -> DataFrame:
        wanted = part.groupBy(F.struct("k1", "k2").alias("k")).agg(F.collect_list(F.struct("ah", "sh", "n", "se")).alias("list")).select("k.*", "list")
        return texts.join(wanted, ["k1", "k2"]).select("row", "k1", "k2", "text", "list").mapInArrow(_extract, "ah long, sh long, n long, starts int, bytes binary")

    judged = bytes_of(undecided.filter("not many")).repartition("ah").sortWithinPartitions("ah").mapInArrow(_judge, "ah long, sh long, a int, b int")
    judged = judged.unionByName(_counted(bytes_of(undecided.filter("many"))))
    first = F.shiftright("se", 16)
    marks = judged.unionByName(sure)
    spans = places.join(marks, ["ah", "sh"]).select("k1", "k2", (first + F.col("a")).alias("a"), (first + F.col("b") - 1 + LENGTH).alias("b"))
    by_text = spans.groupBy(F.struct("k1", "k2").alias("k")).agg(F.collect_list(F.struct("a", "b")).alias("places")).select("k.*", "places")
    kind = texts.schema["row"].dataType.simpleString()
    cut = texts.join(by_text, ["k1", "k2"], "left").select("row", "text", "places").mapInArrow(_cut, f"row {kind}, kept string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    at = {c: F.col("row")[c] for c in own} | {"text": F.col("kept")}
    order = [c for c in docs.columns if c in at]
    return cut.select(*[at[c].alias(c) for c in order], "n_bytes", "n_removed", "n_spans", "kept_sha256")

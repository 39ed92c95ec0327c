"""Benchmark decontamination by template windows.

Texts become token templates in two forms. In both, numbers and units are
replaced by typed placeholders and other words are lower-cased and stripped of
punctuation; the form with names replaces every capitalised word too, whatever
stands before it, the plain form none. So a re-cased copy meets its original in
the plain form, and a question with other names in the form with names.

Windows are hashed on both sides and joined; the shorter the item, the shorter
they are (SIZES), so that one changed word doesn't break all. Matches of one text and
item are grouped by alignment (place in the text less place in the item);
within an alignment a slot's value in the item must always go with the same
value in the text, and the other way round: windows that break that are not
counted. Alignments less than NEARBY apart are added up, as a word put in or a
name of two words shifts what follows. An item contaminates a text if at least
``share`` of its places match (SHORT_SHARE of a short item's), or if RUN do.

Stock phrases: an item that needs k places leaves out its k - 1 commonest ones
when candidates are searched, as one of the others must match. So a phrase that
many items hold brings no text together with all of them, and nothing is lost;
candidates are then compared in all places.

Document windows are as many as words. Before the shuffle they pass a bitmap of
the benchmark's window hashes, sized by their number up to 32 MB; beyond that it
lets more pass, and the joins decide. Copies of a text are matched once.

Defined cases: a null or empty text has no windows; an item of under MIN_TOKENS
tokens can't be told from chance and matches nothing; every row of documents,
repeated rows and null doc_ids too, has its own rows in the result, and so has
every repeated item; an empty benchmark or table gives no matches; very long
texts are read whole, one at a time; columns with clashing names are carried
by ``decontaminate`` and ignored by ``matches``. Ties: of equally good
alignments the one nearest the text's beginning is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, require
from .hashing import mix, powers

#: Items' window sizes: from so many tokens on, windows of so many. Shorter items are one window.
SIZES = ((24, 8), (16, 5), (8, 4))
MIN_TOKENS, SHORT = 4, 16
SHARE, SHORT_SHARE, RUN = 0.3, 0.5, 25
NEARBY = 4
#: Least and greatest size of the bitmap, as powers of two of bits.
LEAST_BITS, MOST_BITS = 20, 28
CACHE_WORDS = 500_000
#: Words that are hashed at once.
CHUNK = 20_000
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "kb mb gb tb hz khz mhz ghz w kw v a k c f degree degrees mph kph".split()
)
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
PLAIN, NAMES = 0, 1
EDGE = "\"'`´’‘“”«»()[]{}<>.,;:!?…*#$%&|_~^+=/\\-–—"
SLOTS = {NUMBER: np.uint64(0xA0761D6478BD642F), UNIT: np.uint64(0xE7037ED1A0B428DB), NAME: np.uint64(0x8EBC6AF09C88C6E3)}


class Words(dict):
    """The number of each distinct word; by number its hash, its kind and whether it begins with a capital. Filled on first use."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.room = 1 << 16
        self.hash, self.kind, self.capital = np.zeros(self.room, np.uint64), np.zeros(self.room, np.int8), np.zeros(self.room, bool)

    def __missing__(self, word: str) -> int:
        bare = word if word.isalpha() else word.strip(EDGE)
        low = bare.lower()
        self[word] = i = len(self)
        if i == self.room:
            self.room *= 2
            self.hash, self.kind, self.capital = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hash, self.kind, self.capital))
        kind = UNIT if low in UNITS else NUMBER if not low.isalpha() and any(c.isdigit() for c in low) else LITERAL
        self.hash[i] = SLOTS.get(kind, None) or xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.kind[i] = kind if low else -1
        self.capital[i] = bare[:1].isupper()
        return i

    def of(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Plain hashes, kinds (a capitalised literal is a NAME) and places of the tokens; words without a letter or digit are none."""
        if len(self) > CACHE_WORDS:
            self.forget()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        kind = self.kind[found]
        at = np.flatnonzero(kind >= 0)
        found, kind = found[at], kind[at]
        return self.hash[found], np.where((kind == LITERAL) & self.capital[found], np.int8(NAME), kind), at


_known = Words()


def known_words() -> Words:
    """The words that this worker's tasks have met so far."""
    return _known


def windows(hashes: np.ndarray, kinds: np.ndarray, size: int, form: int) -> np.ndarray:
    """The hash of each window of that many tokens in that form."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.where(kinds == NAME, SLOTS[NAME], hashes) if form == NAMES else hashes
    up, down = powers(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64((2 * size + form) * 0x9E3779B97F4A7C15 % (1 << 64)))


def usable(kinds: np.ndarray, size: int, form: int) -> np.ndarray:
    """Which windows are looked up: with names, those that have a name, and as many literals as slots at least."""
    n = max(0, len(kinds) - size + 1)
    if form == PLAIN or not n:
        return np.ones(n, bool)
    literals, names = (np.concatenate([[0], np.cumsum(kinds == k)]) for k in (LITERAL, NAME))
    return (2 * (literals[size:] - literals[:n]) >= size) & (names[size:] > names[:n])


def slots(words: list[str], kinds: np.ndarray, at: np.ndarray, first: int, size: int, form: int) -> list[str]:
    """The values of the window's slots, 'kind=value'."""
    none = (LITERAL, NAME) if form == PLAIN else (LITERAL,)
    return [f"{kinds[i]}={words[at[i]].strip(EDGE).lower()}" for i in range(first, first + size) if kinds[i] not in none]


def window_of(tokens: int) -> int:
    """The size of an item's windows."""
    return next((size for least, size in SIZES if tokens >= least), tokens)


def needed_of(tokens: int, share: float = SHARE) -> int:
    """How many of an item's places must match."""
    n = tokens - window_of(tokens) + 1
    return min(max(1, math.ceil(n * (max(share, SHORT_SHARE) if tokens < SHORT else share) - 1e-9)), RUN)


def item_windows(benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """item_row, size, n_windows, needed, hash, item_at, item_slots of every item once, however often it is repeated."""
    require(benchmark, "item_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words()
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").split()
                h, k, at = known.of(words)
                if len(h) < MIN_TOKENS:
                    continue
                size = window_of(len(h))
                for form in (PLAIN, NAMES):
                    place = np.flatnonzero(usable(k, size, form))
                    n = len(place)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array([len(h) - size + 1] * n, pa.int32()), pa.array([needed_of(len(h), share)] * n, pa.int32()), pa.array(windows(h, k, size, form)[place].view(np.int64)), pa.array(place, pa.int32()), pa.array([slots(words, k, at, int(i), size, form) for i in place], pa.list_(pa.string()))],
                        names=["item_row", "size", "n_windows", "needed", "hash", "item_at", "item_slots"],
                    )

    rows = _items(benchmark).select("item_row", "text").dropDuplicates(["item_row"])
    return rows.mapInArrow(task, "item_row long, size int, n_windows int, needed int, hash long, item_at int, item_slots array<string>")


def _items(benchmark: DataFrame) -> DataFrame:
    """The items' rows with item_row, which only equal items share."""
    return benchmark.select(F.xxhash64("item_id", "text").alias("item_row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def _bitmap(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the window hashes, made by the executors: one row per 64 bits that aren't all 0; the window sizes."""
    sizes = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits = max(LEAST_BITS, min(MOST_BITS, (16 * sum(sizes.values())).bit_length()))
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = items.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out, sorted(sizes)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("second"), text)})


def _hits(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """t1, t2, hash, doc_at, word_at, last_word, doc_slots of the windows of the documents' texts that pass the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = known_words(), shared.value
        mask = np.uint64(64 * len(marks) - 1)

        def look_up(held: list[tuple[int, int, list[str]]]) -> Iterator[pa.RecordBatch]:
            words = [w for h in held for w in h[2]]
            whose = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            h, k, at = known.of(words)
            owner = whose[at]
            tokens, places = (np.searchsorted(x, np.arange(len(held))) for x in (owner, whose))  # that stand before each text
            t1, t2 = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
            for size in sizes:
                for form in (PLAIN, NAMES):
                    hashes = windows(h, k, size, form)
                    low = hashes & mask
                    hit = (marks[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
                    first = np.flatnonzero(hit.astype(bool) & usable(k, size, form) & (owner[: len(hashes)] == owner[size - 1 :][: len(hashes)]))
                    if len(first):
                        own = owner[first]
                        values = [slots(words, k, at, int(i), size, form) for i in first]
                        columns = (hashes[first].view(np.int64), (first - tokens[own]).astype(np.int32), (at[first] - places[own]).astype(np.int32), (at[first + size - 1] - places[own]).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(t1[own]), pa.array(t2[own]), *map(pa.array, columns), pa.array(values, pa.list_(pa.string()))], names=["t1", "t2", "hash", "doc_at", "word_at", "last_word", "doc_slots"])

        for batch in batches:
            held, size = [], 0
            for t1, t2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().split()
                if len(words) < sizes[0]:
                    continue
                held.append((t1, t2, words))
                size += len(words)
                if size >= CHUNK:
                    yield from look_up(held)
                    held, size = [], 0
            if held:
                yield from look_up(held)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = _keyed(docs).select("t1", "t2", text.alias("text")).mapInArrow(task, "t1 long, t2 long, hash long, doc_at int, word_at int, last_word int, doc_slots array<string>")
    return found.groupBy("t1", "t2", "hash", "doc_at").agg(F.first(F.struct("word_at", "last_word", "doc_slots")).alias("x")).select("t1", "t2", "hash", "doc_at", "x.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame | None:
    """t1, t2, item_row, n_matched, n_windows, shift, first_word, last_word of every different text and item that contaminates it; None without items."""
    require(docs, "text")
    items = durable(item_windows(benchmark, share))
    bitmap, sizes = _bitmap(items)
    if not sizes:
        return None
    hits = durable(_hits(docs, bitmap, sizes))
    # Of each item all but its commonest places bring candidates.
    common = items.groupBy("hash").agg(F.countDistinct("item_row").alias("items"))
    places = items.join(common, "hash").groupBy("item_row", "item_at", "needed").agg(F.max("items").alias("items"))
    order = Window.partitionBy("item_row").orderBy(F.desc("items"), "item_at")
    rare = places.withColumn("rank", F.row_number().over(order)).filter("rank >= needed").select("item_row", "item_at")
    keys = durable(items.join(rare, ["item_row", "item_at"]).select("hash", "item_row").distinct())
    candidates = hits.select("t1", "t2", "hash").join(keys, "hash").groupBy(F.struct("t1", "t2", "item_row").alias("c")).agg(F.lit(1).alias("one")).select("c.*")
    wanted = durable(candidates.join(items, "item_row"))
    joined = hits.join(wanted, ["t1", "t2", "hash"]).filter(F.size("doc_slots") == F.size("item_slots"))
    pairs = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda p: F.struct(p["item_slots"].alias("i"), p["doc_slots"].alias("d")))
    joined = durable(joined.select("t1", "t2", "item_row", "n_windows", "needed", (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at", "word_at", "last_word", pairs.alias("pairs")))
    place = ["t1", "t2", "item_row", "shift"]
    # A slot value of either side that goes with two values of the other is inconsistent.
    used = joined.select(*place, F.explode("pairs").alias("p")).distinct()
    for name, side, other in (("bad_item", "i", "d"), ("bad_doc", "d", "i")):
        broken = used.groupBy(*place, F.col(f"p.{side}").alias("value")).agg(F.countDistinct(f"p.{other}").alias("n")).filter("n > 1")
        joined = joined.join(broken.groupBy(*place).agg(F.collect_set("value").alias(name)), place, "left")  # no more values than an item has slots
    none = F.array().cast("array<string>")
    fits = ~F.exists(F.col("pairs"), lambda p: F.array_contains(F.coalesce("bad_item", none), p["i"]) | F.array_contains(F.coalesce("bad_doc", none), p["d"]))
    # Alignments nearby fall into one of two ranges together.
    ranges = F.array(*[F.struct(F.lit(k).alias("k"), F.floor((F.col("shift") + k * NEARBY) / (2 * NEARBY)).alias("r")) for k in (0, 1)])
    text = ["t1", "t2", "item_row", "n_windows", "needed"]
    near = joined.filter(fits).withColumn("range", F.explode(ranges)).groupBy(*text, "range").agg(
        F.countDistinct("item_at").cast("int").alias("n_matched"), F.min("shift").alias("shift"), F.min("word_at").alias("first_word"), F.max("last_word").alias("last_word")
    )
    near = near.filter("n_matched >= needed")
    best = near.groupBy(*text).agg(F.max(F.struct("n_matched", (-F.col("first_word")).alias("start"), (-F.col("shift")).alias("shift"), "last_word")).alias("b"))
    return best.select(*text[:-1], F.col("b.n_matched").alias("n_matched"), (-F.col("b.shift")).alias("shift"), (-F.col("b.start")).alias("first_word"), F.col("b.last_word").alias("last_word"))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document row and item that contaminates it: doc_id, item_id, n_matched, n_windows, share, shift, first_word, last_word."""
    require(docs, "doc_id", "text")
    found = contaminated(docs, benchmark, share)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_matched int, n_windows int, share double, shift int, first_word int, last_word int")
    by_item = durable(found.join(_items(benchmark).select("item_row", "item_id"), "item_row"))
    rows = _keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "t1", "t2")
    return rows.join(by_item, ["t1", "t2"]).select(
        "doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("share"), "shift", "first_word", "last_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs that no item contaminates; all columns stay."""
    found = contaminated(docs.select("text"), benchmark, share)
    if found is None:
        return docs
    tagged = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")).drop("text")
    return tagged.join(durable(found.select("t1", "t2").distinct()), ["t1", "t2"], "left_anti").select("row.*")

"""LM scoring by context-tree weighting over bytes, beside a unigram base.

The model reads a text as its lower-cased (A-Z) words joined by single spaces,
and one closing byte; its score is log10 of that string's probability, so code
length per byte is -score / log10(2) / n_bytes. See ``context_tree``.

Counting covers every training text: each task sums the codes of all bytes
with the DEPTH bytes before them, and the 64-bit hashes of all tokens; both are
added up by a shuffle. The tree holds every context counted. It is weighted in
parts: the grams are dealt by the two bytes before the last one, each task
weights the subtrees below its pairs, and the driver only joins the pairs' own
nodes (at most 2 ** 16 contexts, however large the corpus is). A second pass
hands each gram of any text, held out or not, the log10 of its probability.

Neither grams nor tokens have a bound: the most frequent ones, HOT_GRAMS and
HOT at most, are sent to every task, and a text's others are joined with the
grams' probabilities and the tokens' counts by a shuffle.

Defined cases: a null text is empty, which is the end alone; a null doc_id
reads as an empty string, whose remainder is 0 (held out); every row is scored,
repeated rows too; without any training document every token has count 0 and
the model predicts every bit by 1/2; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, require
from .context_tree import END, TOP, Level, Subtrees, grams, top_levels
from .hashing import word_bounds, word_hashes

DEPTH = 5
HOT = 1 << 19
HOT_GRAMS = 1 << 20
#: About so many grams are weighted by a task.
PART = 250_000
#: Bytes of text that are counted at once.
CHUNK = 2_000_000
GRAM, TOKEN = 0, 1
#: Stands for the closing token, which no word's hash is told apart from by more than chance.
END_HASH = np.int64(-7046029254386353131)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def plain(text: str | None) -> bytes:
    """The string that the model reads, without its end."""
    return b" ".join((text or "").encode().lower().split())


def _hashes(data: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(data, np.uint8)).view(np.int64) if data else np.zeros(0, np.int64)


class _Sums:
    """Sums by key that hold little more than the distinct keys."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, each: int = 1) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.waiting.append((keys, counts * each))
        if sum(len(k) for k, _ in self.waiting) > 3_000_000:
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts, self.waiting = keys[first], np.add.reduceat(counts, first) if len(keys) else counts, []


def _padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their ends, each after padding; which bytes end a gram (grams may not run from one text into the next)."""
    pad = bytes([END]) * depth
    whole = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 + depth for t in texts])
    inside = np.ones(len(whole), bool)
    inside[((np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)).ravel()] = False
    return whole, inside


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n: how often each gram and each token stands in the texts that aren't held out. Grams of held-out texts are listed too, if only with 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {GRAM: _Sums(), TOKEN: _Sums()}
        held: dict[bool, list[bytes]] = {False: [], True: []}

        def flush() -> None:
            for out, texts in held.items():
                if texts:
                    whole, inside = _padded(texts, depth)
                    sums[GRAM].add(grams(whole, depth)[inside[depth:]], 0 if out else 1)
                    if not out:
                        sums[TOKEN].add(np.concatenate([_hashes(b" ".join(texts)), np.full(len(texts), END_HASH)]))
                    texts.clear()

        size = 0
        for batch in batches:
            for t, out in zip(batch.column(0), batch.column(1), strict=True):
                text = plain(t.as_py())
                held[out.as_py()].append(text)
                size += len(text)
                if size > CHUNK:
                    flush()
                    size = 0
        flush()
        for kind, s in sums.items():
            s.settle()
            for at in range(0, len(s.keys), 100_000):
                k, c = s.keys[at : at + 100_000], s.counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)], names=["kind", "key", "n"])

    return docs.select(F.col("text").cast("string"), "held_out").mapInArrow(task, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_scores(counts: DataFrame, depth: int = DEPTH, part: int = PART) -> DataFrame:
    """key, n, log10 of every gram counted: the probability of its last byte after the others, by the tree of all contexts."""
    sc = counts.sparkSession.sparkContext
    listed = counts.filter(F.col("kind") == GRAM).select("key", "n")
    parts = max(12, -(-listed.count() // part))
    dealt = listed.repartition(parts, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(k for k, _ in held)]), np.concatenate([none, *(n for _, n in held)])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bit, (ids, *rest) in enumerate(Subtrees(*read(batches), depth).roots()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bit, np.int32)), pa.array(ids), *(pa.array(x.astype(float)) for x in rest)], names=["bit", "id", "zeros", "ones", "mixed"])

    found = dealt.mapInArrow(roots, "bit int, id long, zeros double, ones double, mixed double").toArrow()
    bits, *columns = (found.column(x).to_numpy() for x in ("bit", "id", "zeros", "ones", "mixed"))
    top: list[list[Level]] = [top_levels(bit, *(x[bits == bit] for x in columns)) for bit in range(8)]
    shared = sc.broadcast(top)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = read(batches)
        logs = Subtrees(keys, n, depth).log10(keys, shared.value)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (keys, n, logs)], names=["key", "n", "log10"])

    return dealt.mapInArrow(score, "key long, n long, log10 double")


def frequent(counted: DataFrame, most: int, value: str = "n") -> tuple[np.ndarray, np.ndarray, int, int]:
    """Keys (sorted) and values of the most frequent rows, the sum of all counts, and how many are counted."""
    counted = counted.filter("n > 0")
    step = F.floor(F.log2("n") * 16)
    levels = sorted(((r["step"], r["k"], r["s"]) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("n").alias("s")).collect()), reverse=True)
    room, least = most, None  # a few hundred levels at most
    for level, k, _ in levels:
        if k > room:
            break
        room, least = room - k, level
    total, distinct = sum(s for _, _, s in levels), sum(k for _, k, _ in levels)
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0), total, distinct
    hot = counted.filter(step >= least).select("key", value).toArrow()
    keys, values = hot.column("key").to_numpy(), hot.column(value).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order], total, distinct


def score_documents(docs: DataFrame, folds: int = 10, depth: int = DEPTH, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row."""
    require(docs, "doc_id", "text")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    counts = durable(count(rows, depth))
    logs = durable(gram_scores(counts, depth))
    tree = sc.broadcast(frequent(logs, hot_grams, "log10")[:2])
    keys, n, total, distinct = frequent(counts.filter(F.col("kind") == TOKEN), hot)
    known = sc.broadcast((keys, n))
    log_base = float(np.log10(total + 0.1 * (distinct + 1)))

    def score(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """By text, the sum over its frequent grams, its other grams and how often it has them."""
        hot_keys, hot_log = tree.value
        whole, inside = _padded(texts, depth)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 + depth for t in texts])
        sums, rest, whose = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for at in range(0, len(whole) - depth, CHUNK):
            use = inside[at + depth : at + depth + CHUNK]
            codes, mine = grams(whole[at : at + depth + CHUNK], depth)[use], owner[at + depth : at + depth + CHUNK][use]
            i = np.searchsorted(hot_keys, codes)
            found = np.zeros(len(codes), bool)
            within = i < len(hot_keys)
            found[within] = hot_keys[i[within]] == codes[within]
            sums += np.bincount(mine[found], weights=hot_log[i[found]], minlength=len(texts))
            rest.append(codes[~found])
            whose.append(mine[~found])
        others, who = np.concatenate(rest), np.concatenate(whose)
        cuts = np.searchsorted(who, np.arange(1, len(texts)))
        each = [np.unique(x, return_counts=True) for x in np.split(others, cuts)]
        return sums, [k for k, _ in each], [c for _, c in each]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_n = known.value
        log_n = np.log10(hot_n + 0.1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [plain(t.as_py()) for t in part.column(1)]
                scores, other, other_n = score(texts)
                out: list[list] = [[], [], [], [], []]
                whole = b"\n".join(texts)
                data = np.frombuffer(whole, np.uint8)
                hashes = _hashes(whole)
                starts, _ = word_bounds(data)
                ends = np.cumsum([len(t) + 1 for t in texts])
                cut = np.searchsorted(starts, ends)
                for k in range(len(texts)):
                    tokens, tf = np.unique(np.append(hashes[cut[k - 1] if k else 0 : cut[k]], END_HASH), return_counts=True)
                    i = np.searchsorted(hot_keys, tokens)
                    found = np.zeros(len(tokens), bool)
                    inside = i < len(hot_keys)
                    found[inside] = hot_keys[i[inside]] == tokens[inside]
                    for x, v in zip(out, (int(tf.sum()), int(tf[found].sum()), float((tf[found] * (log_n[i[found]] - log_base)).sum()), tokens[~found], tf[~found]), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)), pa.array(scores), pa.array(other, pa.list_(pa.int64())), pa.array(other_n, pa.list_(pa.int64())), pa.array([len(t) + 1 for t in texts], pa.int64())],
                    names=["doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "rest", "rest_tf", "score", "grams", "grams_tf", "n_bytes"],
                )

    scored = durable(rows.mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, hot_known long, hot_score double, rest array<long>, rest_tf array<long>, score double, grams array<long>, grams_tf array<long>, n_bytes long"))
    scored = scored.withColumn("row", F.monotonically_increasing_id())  # over a checkpoint: the same each time
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_tf")).alias("r")).select("row", F.col("r.rest").alias("key"), F.col("r.rest_tf").alias("tf"))
    rare = counts.filter(F.col("kind") == TOKEN).select("key", "n")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rest.join(rare, "key", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rest_known"), F.sum(F.col("tf") * (F.log10(c + 0.1) - F.lit(log_base))).alias("rest_score")
    )
    others = scored.select("row", F.explode(F.arrays_zip("grams", "grams_tf")).alias("g")).select("row", F.col("g.grams").alias("key"), F.col("g.grams_tf").alias("tf"))
    more = others.join(logs.select("key", "log10"), "key").groupBy("row").agg(F.sum(F.col("tf") * F.col("log10")).alias("rest_log10"))  # logs has every gram
    return scored.join(sums, "row", "left").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rest_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_log10", F.lit(0.0))).alias("score"),
        "n_bytes",
    )

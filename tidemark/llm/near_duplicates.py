"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of their runs of WORDS words; two texts are linked if the
Jaccard similarity of their sets is THRESHOLD or more.

1. Equal texts are one class, keyed by two 64-bit hashes of the text.
2. Each text's MinHash signature (BANDS * ROWS values) is cut into bands. Texts
   that agree in a band are candidates: they stand in one bucket. At similarity
   0.8 a pair shares no band with probability 5e-6, and falls with every bit more.
3. Buckets aren't expanded into pairs. Every text has a home, the least member
   of all its buckets; PULLS times it moves to the least home that any bucket of
   its holds, so that texts of one cluster share a home, however loosely its
   outer ones hang on. n texts of a home are dealt over the root of n / BLOCK
   blocks, or more where a block would exceed BLOCK_BYTES. Two blocks are
   compared, as a tile, only if some bucket has members of both; a tile is a
   task's unit, so no task holds more than two blocks and none emits pairs. A
   text goes to as many tiles as it has blocks to meet, so a cluster of n sends
   n times the root of n / BLOCK texts: n ** 1.5, where its pairs are n ** 2.
4. In a tile, MinHash values are compared STEP at a time; a pair is dropped when
   the posterior probability (uniform prior) that its similarity reaches the
   threshold falls below TOLERANCE. What is left is verified exactly.
5. A tile gives each member its number of links there, and an edge to the least
   member that it is connected to there. Sums and the connected components of
   those edges give the result.

Defined cases: a null or empty text, or one without words, has no shingles and
is linked to nothing, not even to texts equal to it; a text of under five words
has one shingle, all its words; words are compared as they stand; equal texts
are linked to each other; every row gives one row, repeated rows and null
doc_ids too: they count as documents; class_id is the least non-null doc_id of
the class, null if there is none, and own doc_id where nothing is linked; very
long texts are read whole, and two of them meet in one task; other columns are
carried by ``deduplicate`` whatever their names, and ignored otherwise; an empty
table gives no rows. Ties: of rows with a class's least doc_id the one with the
least text key stays, then the one with the least hash of all its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, require, with_text_key
from .hashing import Stretches, mix, word_bounds

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
STEP, TOLERANCE = 24, 1e-6
#: A home of n texts has sqrt(n / BLOCK) blocks of sqrt(n * BLOCK) texts, one up to BLOCK texts; a tile compares two blocks.
BLOCK = 400
#: Bytes of text in a block, whatever the number of texts.
BLOCK_BYTES = 8 << 20
#: Times that texts move to the least home in their buckets.
PULLS = 2
#: A tile's sets are compared this many with this many at a time.
PART = 400

_multipliers = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_addends = np.random.default_rng(12).integers(0, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"", np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = Stretches(data)(starts, ends)
    size = min(WORDS, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values; as many hash functions as BANDS * ROWS."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        for f in range(0, BANDS * ROWS, 48):
            values = part[None, :] * _multipliers[f : f + 48, None] + _addends[f : f + 48, None]
            np.minimum(out[f : f + 48], values.min(axis=1), out=out[f : f + 48])
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sig.reshape(BANDS, ROWS)[:, r].astype(np.uint64))
    return key.view(np.int64)


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of compared values, the least number of equal ones with which a pair stays.

    With m of n equal the posterior is Beta(m + 1, n - m + 1); that it lies at
    the threshold or above has the probability that a binomial of n + 1 draws
    at the threshold is m at most.
    """
    from math import comb

    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out[n] = m
    return out


def linked_pairs(sets: list[np.ndarray], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of places whose sets are similar: a < first <= b, or all a < b if first is 0 or the number of sets; of PART by PART places at a time."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    sig = np.array([signature(s) for s in sets]).reshape(n, -1)
    square = first in (0, n)
    parts = lambda low, high: [np.arange(i, min(i + PART, high)) for i in range(low, high, PART)]
    for left in parts(0, n if square else first):
        for right in parts(left[0] if square else first, n):
            a, b = _candidates(sizes, sig, left, right)
            common = _intersections(sets, a, b)
            good = common >= THRESHOLD * (sizes[a] + sizes[b] - common) - 1e-9
            yield a[good], b[good]


def _candidates(sizes: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of these places that sizes and MinHash values let pass."""
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bound = least_matches()
    for a in left:
        b = right[right > a]
        # Sizes alone bound the similarity.
        b = b[(np.minimum(sizes[b], sizes[a]) >= THRESHOLD * np.maximum(sizes[b], sizes[a])) & (sizes[b] > 0)]
        same = np.zeros(len(b), np.int64)
        for k in range(0, BANDS * ROWS, STEP):
            same += (sig[b, k : k + STEP] == sig[a, k : k + STEP]).sum(axis=1)
            keep = same >= bound[k + STEP]
            b, same = b[keep], same[keep]
            if not len(b):
                break
        lefts.append(np.full(len(b), a))
        rights.append(b)
    return np.concatenate(lefts), np.concatenate(rights)


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each pair shares, exactly."""
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    # Many pairs among few sets: count by blocks of columns of the incidence matrix; what one set alone holds is in no intersection.
    lefts, rights = np.unique(a), np.unique(b)
    values = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    shared = ~(new & np.concatenate([new[1:], [True]]))
    column, owner = np.cumsum(new[shared]) - 1, owner[shared]
    from_left, from_right = np.searchsorted(used, lefts), np.searchsorted(used, rights)
    common = np.zeros((len(lefts), len(rights)), np.float32)
    for at in range(0, column[-1] + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((len(used), column[hi - 1] + 1 - at), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        common += x[from_left] @ x[from_right].T
    return common[np.searchsorted(lefts, a), np.searchsorted(rights, b)].astype(np.int64)


def least_of(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the least place that each place is connected to, after places a and b are connected too."""
    root = root.copy()
    while len(a):
        x, y = root[a], root[b]
        a, b, x, y = a[x != y], b[x != y], x[x != y], y[x != y]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component of every node that edges (a, b) connect; the component is its least node.

    Every round each node is merged into the first node, in some order, among
    its neighbours and itself; edges between merged nodes are relabelled, and
    loops and repeats of them go, so later rounds are small. The order is that
    of the nodes in the first rounds, which collapses stars at once, then a
    hash that differs from round to round, which halves long chains too.
    Partial aggregation keeps a node with very many neighbours from being
    gathered in one task.
    """
    least, greatest = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    live = durable(edges.filter("a <> b").select(greatest, least).distinct())
    labels = None
    for number in range(most):
        if number < 3:
            both = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
            merged = both.unionByName(live.select(F.col("b").alias("node"), F.col("b").alias("to"))).groupBy("node").agg(F.min("to").alias("to"))
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("n"))
            near = live.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(live.select(F.col("b").alias("node"), rank("a").alias("r")))
            near = near.unionByName(near.select("node").distinct().select("node", rank("node").alias("r")))
            merged = near.groupBy("node").agg(F.min("r").alias("r")).select("node", F.col("r.n").alias("to"))
        merged = durable(merged)
        labels = merged if labels is None else durable(labels.join(merged.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        to_a, to_b = merged.select(F.col("node").alias("a"), F.col("to").alias("x")), merged.select(F.col("node").alias("b"), F.col("to").alias("y"))
        live = durable(live.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if live.isEmpty():
            names = labels.groupBy("to").agg(F.min("node").alias("component"))
            return labels.join(names, "to").select("node", "component")
    raise RuntimeError("components did not settle")


def _node(k1: Column, k2: Column) -> Column:
    """A text's key as one value that sorts."""
    return F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, k1, k2, has_words of every row."""
    rows = with_text_key(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.withColumn("has_words", F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False)))


def _blocks(member: DataFrame) -> DataFrame:
    """k1, block of every text among a bucket's members (k1, band, least, size)."""
    home = durable(member.groupBy("k1").agg(F.min("least").alias("home"), F.max("size").alias("size")))
    for _ in range(PULLS):
        # Written, so that Spark can split the join at a large bucket.
        nearest = durable(member.select("k1", "band").join(home, "k1").groupBy("band").agg(F.min("home").alias("home")))
        home = durable(member.join(nearest, "band").groupBy(F.struct("k1").alias("m")).agg(F.min("home").alias("home"), F.max("size").alias("size")).select("m.k1", "home", "size"))
    count = F.greatest(F.ceil(F.sqrt(F.count("*") / BLOCK)), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    sizes = durable(home.groupBy("home").agg(count.alias("blocks")))
    return durable(home.join(sizes, "home").select("k1", F.xxhash64("home", F.pmod(F.xxhash64(F.lit("block"), "k1"), F.col("blocks"))).alias("block")))


def classes_of(rows: DataFrame) -> DataFrame:
    """k1, k2, class_id, class_key, n_copies, links, has_words of every different text with words; links to other texts."""

    def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = [bands(signature(shingles(t.as_py()))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["k1", "size", "keys"])

    texts = rows.filter("has_words")
    keyed = texts.select("k1", "text").mapInArrow(band_keys, "k1 long, size int, keys array<long>").select("k1", "size", F.explode("keys").alias("band"))
    # A bucket with two different texts: their keys' least and greatest differ. Texts with equal k1 and different k2 go the same way.
    band = durable(keyed)
    bucket = durable(band.groupBy("band").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).filter("least != most").select("band", "least"))
    member = durable(band.join(bucket, "band").groupBy(F.struct("k1", "band", "least").alias("m")).agg(F.max("size").alias("size")).select("m.*", "size"))
    block = _blocks(member)
    # Blocks that meet in a bucket. Most buckets lie within one block.
    meet = durable(member.select("k1", "band").join(block, "k1").groupBy(F.struct("band", "block").alias("m")).agg(F.lit(1).alias("one")).select("m.*"))
    wide = durable(meet.groupBy("band").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low != high").select("band"))
    crossing = durable(meet.join(wide, "band").groupBy(F.struct("band", "block").alias("m")).agg(F.lit(1).alias("one")).select("m.*"))
    pairs = crossing.select("band", F.col("block").alias("ti")).join(crossing.select("band", F.col("block").alias("tj")), "band").filter("ti < tj")
    pairs = pairs.groupBy(F.struct("ti", "tj").alias("t")).agg(F.lit(1).alias("one")).select("t.*")
    whole = block.groupBy("block").agg(F.count("*").alias("n")).select(F.col("block").alias("ti"), F.col("block").alias("tj"))
    tile_list = durable(pairs.unionByName(whole))
    sides = durable(
        tile_list.select("ti", "tj", F.col("ti").alias("block"), F.lit(0).alias("side")).unionByName(tile_list.filter("ti != tj").select("ti", "tj", F.col("tj").alias("block"), F.lit(1).alias("side")))
    )
    # Copies of a text are one member with a count; the struct has the join dealt anew, so that Spark can split a text with very many copies.
    members = texts.select("k1", "k2", "text").join(block, "k1").groupBy(F.struct("k1", "k2").alias("k")).agg(F.first("text").alias("text"), F.first("block").alias("block"), F.count("*").alias("copies"))
    members = durable(members.select("k.*", "text", "block", "copies"))
    tiles = members.join(sides, "block")

    def tile(group: pa.Table) -> pa.Table:
        side, square = group.column("side").to_numpy(), group.column("ti")[0].as_py() == group.column("tj")[0].as_py()
        order = np.argsort(side, kind="stable")
        group = group.take(pa.array(order))
        sets = [shingles(t.as_py()) for t in group.column("text")]
        copies = group.column("copies").to_numpy()
        n, root = np.zeros(len(sets)), np.arange(len(sets))
        for a, b in linked_pairs(sets, 0 if square else int((side == 0).sum())):
            n += np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
            root = least_of(root, a, b)
        at = np.flatnonzero(n > 0)
        k1, k2 = group.column("k1").to_numpy()[at], group.column("k2").to_numpy()[at]
        r1, r2 = group.column("k1").to_numpy()[root[at]], group.column("k2").to_numpy()[root[at]]
        return pa.table({"k1": k1, "k2": k2, "r1": r1, "r2": r2, "links": n[at].astype(np.int64)})

    found = durable(tiles.groupBy("ti", "tj").applyInArrow(tile, "k1 long, k2 long, r1 long, r2 long, links long"))
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    joined = components(found.select(_node(F.col("k1"), F.col("k2")).alias("a"), _node(F.col("r1"), F.col("r2")).alias("b")))
    ids = texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"))
    ids = durable(ids.join(links, ["k1", "k2"], "left").withColumn("node", _node(F.col("k1"), F.col("k2"))).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    classes = durable(ids.groupBy("component").agg(F.min("least_id").alias("class_id")))  # written: Spark can split the join at a large class
    return ids.join(classes, "component").select("k1", "k2", "class_id", F.col("component").alias("class_key"), "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.lit(True).alias("has_words"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, k1, k2, class_key of every row.

    class_id and class_key are shared by all that links connect; class_key is
    null for texts without words, and stands for the class where ids are null.
    """
    require(docs, "doc_id", "text")
    rows = _keyed(docs)
    known = classes_of(rows)
    return rows.select("doc_id", "k1", "k2", "has_words").join(known, ["k1", "k2", "has_words"], "left").select(
        "doc_id",
        F.when(F.col("n_copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("n_copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "k1",
        "k2",
        "class_key",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: the least doc_id's; texts without words all stay."""
    require(docs, "doc_id", "text")
    classes = classes_of(_keyed(docs)).filter("links > 0 or n_copies > 1").select("k1", "k2", "class_id", "class_key")
    rows = with_text_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    marked = rows.drop("text").join(durable(classes), ["k1", "k2"], "left")
    # Of a class only rows with its least doc_id can stay; repeated ones of these are settled by partial minima, not by a window over the class.
    alone = marked.filter("class_key is null")
    tied = marked.filter(F.col("class_key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = tied.groupBy(F.struct("class_key").alias("c")).agg(F.min_by("row", F.struct("k1", "k2", F.xxhash64(F.to_json("row")))).alias("row"))
    return alone.select("row").unionByName(first.select("row")).select("row.*")

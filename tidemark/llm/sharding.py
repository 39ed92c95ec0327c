"""Sharding by vector bin packing.

Groups of equal texts are placed so that bytes, tokens (words) and rows are
balanced jointly: a group goes to the shard where the dot product of its
vector with the shard's residual capacity is highest.

Groups are as many as there are texts, so they aren't placed one by one.
Heavy groups (over 1/64 of a shard in a dimension: at most 64 * 3 * shards)
are items of their own, and all others are bundled by a hash of their text
into a fixed number of items. A group over half a shard is split by doc_id,
as no placement could balance it whole: equal texts share a shard except in
such a group. Placing handles a bounded number of items on the driver, whatever
the input; moves and swaps of items then level all three dimensions together.

Defined cases: a null text has size 1 and is a group with the empty text; rows
with a null doc_id and repeated rows are placed like any other; an empty table
gives no rows; input columns other than doc_id and text are ignored; texts of
any length are sizes only. Ties: of equally good shards the first gets an item,
of equally heavy items the first by hash is placed first; slots follow doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, rank_within, require, with_text_key

BUNDLES = 8192
#: The share of a shard from which a group is an item of its own, and from which it is split.
HEAVY, SPLIT = 1 / 64, 1 / 2
DIMENSIONS = ("size", "tokens", "one")
#: How much a deviation in each dimension counts when shards are levelled; bytes are the law of the query.
WEIGHTS = (4.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of items: its size in every dimension), largest first."""
    totals = items.sum(axis=0)
    share = items / np.where(totals > 0, totals, 1)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        s = int(np.argmax(residual @ share[i]))
        out[i] = s
        residual[s] -= share[i]
    return out


def level(items: np.ndarray, where: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Moves and swaps items between shards while that lowers the weighted sum of squared deviations from an equal share, in all dimensions at once.

    Ties go to the first shard and the first items; what ``place`` did stays wherever no exchange is better.
    """
    totals = items.sum(axis=0)
    x = items * (shards * np.sqrt(np.array(weights)) / np.where(totals > 0, totals, 1))  # an equal share is the square root of the weight
    where, ideal = where.copy(), np.where(totals > 0, np.sqrt(np.array(weights)), 0)
    off = np.stack([np.bincount(where, x[:, d], shards) for d in range(x.shape[1])], axis=1) - ideal
    for _ in range(40 * shards):
        a = int(np.argmax((off**2).sum(axis=1)))
        mine = np.flatnonzero(where == a)
        for b in np.argsort(off @ off[a], kind="stable"):  # the shard that deviates most the other way comes first
            if b == a:
                continue
            theirs = np.flatnonzero(where == b)
            half = (off[a] - off[b]) / 2
            # A change of d from a to b lowers the sum by 2 * (|half|**2 - |d - half|**2); row and column 0 stand for no item.
            p, q = np.vstack([np.zeros(x.shape[1]), x[mine]]), np.vstack([np.zeros(x.shape[1]), x[theirs]])
            far = ((p - half) ** 2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None, :] - 2 * (p - half) @ q.T
            i, j = np.unravel_index(int(np.argmin(far)), far.shape)
            if far[i, j] < (half**2).sum() * (1 - 1e-9) - 1e-15:
                break
        else:
            return where
        d = p[i] - q[j]
        off[a], off[b] = off[a] - d, off[b] + d
        if i:
            where[mine[i - 1]] = b
        if j:
            where[theirs[j - 1]] = a
    return where


def vector_shards(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, tokens, text_crc32, k1, k2, shard, slot of every row; slots are gapless from 0 in each shard."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""))
    rows = durable(
        with_text_key(docs.select(F.col("doc_id").cast("long"), "text")).select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), words.cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), "k1", "k2"
        )
    )
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("one")]
    total = rows.agg(*sums).first()
    limit = {d: max(1.0, total[d] / shards) for d in DIMENSIONS}
    groups = rows.groupBy("k1", "k2").agg(*sums)
    load = F.greatest(*[F.col(d) / F.lit(limit[d]) for d in DIMENSIONS])
    heavy = groups.filter(load > HEAVY).withColumn("parts", F.when(load > SPLIT, F.ceil(load / SPLIT)).otherwise(1).cast("int"))
    heavy = heavy.select("k1", "k2", "parts").collect()  # at most 3 * shards / HEAVY
    names = pa.table({k: pa.array([r[k] for r in heavy], t) for k, t in (("k1", pa.int64()), ("k2", pa.int64()), ("parts", pa.int32()))})
    known = F.broadcast(spark.createDataFrame(names))
    # An item is a part of a heavy group, or (part -1) a bundle of light ones.
    item = rows.join(known, ["k1", "k2"], "left").withColumns({
        "part": F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int"),
        "i1": F.when(F.col("parts").isNull(), F.pmod(F.col("k1"), F.lit(bundles))).otherwise(F.col("k1")),
        "i2": F.when(F.col("parts").isNull(), 0).otherwise(F.col("k2")),
    })
    key = ["part", "i1", "i2"]
    found = item.groupBy(*key).agg(*sums).orderBy(*key).collect()  # at most bundles + the heavy parts
    items = np.array([[r[d] for d in DIMENSIONS] for r in found], float).reshape(-1, 3)
    where = level(items, place(items, shards), shards)
    placed = pa.table({k: pa.array([r[k] for r in found], t) for k, t in (("part", pa.int32()), ("i1", pa.int64()), ("i2", pa.int64()))} | {"shard": pa.array(where, pa.int32())})
    out = item.join(F.broadcast(spark.createDataFrame(placed)), key).drop(*key, "parts")
    return rank_within(out, ["shard"], ["doc_id", "k1", "k2"], "slot", total["one"])

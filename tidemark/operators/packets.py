"""Packet queries. A packet table has key columns that name a track, ``seq`` (decode order) and ``us`` (presentation time).

Decode order and presentation order differ where a codec reorders frames, so
every operator says which of the two it follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the time buckets that spread one track over many tasks in as-of lookups.
BUCKET_US = 3_600_000_000


def first_packet(packets: DataFrame, keys: Sequence[str], columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """The first packet of each track in decode order, among those that satisfy ``where``."""
    rows = packets if where is None else packets.filter(where)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "seq").alias("p")).select(*keys, "p.*")


def last_packet(packets: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The packet of each track that is presented last; of equal times the one that is decoded last."""
    return packets.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("us", "seq")).alias("p")).select(*keys, "p.*")


def next_packet(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the successor in decode order."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return packets.withColumns({"next_seq": F.lead("seq").over(w), "next_us": F.lead("us").over(w)})


def next_key_packet(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the next key packet in decode order."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return packets.withColumn("next_key_seq", F.first(F.when(F.col("key"), F.col("seq")), ignorenulls=True).over(w))


def packet_range(packets: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packets from start_seq up to, without, end_seq in decode order; bounds has a row per track (null: open)."""
    joined = packets.join(bounds, list(keys))
    return joined.filter((F.col("start_seq").isNull() | (F.col("seq") >= F.col("start_seq"))) & (F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))))


def as_of(probes: DataFrame, base: DataFrame, keys: Sequence[str], value: Sequence[str], at: str = "us", bucket_us: int = BUCKET_US) -> DataFrame:
    """Adds to each probe the ``value`` columns of the last base row at or before it (nulls if none); ties go to the greatest values.

    Rows are dealt by track and time bucket, so a long track is many tasks. A
    bucket without an earlier base row takes the last one of the buckets before
    it, which come from one row per bucket.
    """
    found = F.struct(F.col(at).alias("_at"), *value)
    none = F.lit(None).cast(base.select(found.alias("s")).schema["s"].dataType)
    bucket = F.floor(F.col(at) / F.lit(bucket_us)).cast("long")
    b = base.filter(F.col(at).isNotNull()).select(*keys, bucket.alias("_bucket"), F.col(at).alias("_t"), found.alias("_base"))
    q = probes.withColumns({"_bucket": bucket, "_t": F.col(at), "_base": none})
    both = q.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    local = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_base").rowsBetween(Window.unboundedPreceding, 0)
    hits = both.withColumn("_hit", F.last("_base", ignorenulls=True).over(local)).filter("_side = 1")
    ends = b.groupBy(*keys, "_bucket").agg(F.max("_base").alias("_end"))
    # Every bucket that a probe or a base row falls in, with the last base row of those before it.
    named = ends.unionByName(q.select(*keys, "_bucket").distinct().withColumn("_end", none)).groupBy(*keys, "_bucket").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    place = [*keys, "_bucket"]
    carried = named.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(place)], F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(place)]
    out = hits.join(carried, same, "left")
    return out.select(*probes.columns, *[F.coalesce("_hit", "_carried")[v].alias(v) for v in value])


def sample_range(packets: DataFrame, keys: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Samples in [start, end) in presentation order, and the one that covers start."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    rows = packets.withColumn("_next", F.lead("us").over(w))
    return rows.filter((F.col("us") < end) & ((F.col("us") >= start) | F.col("_next").isNull() | (F.col("_next") > start))).drop("_next")


def samples_at(packets: DataFrame, times: DataFrame, keys: Sequence[str], value: Sequence[str]) -> DataFrame:
    """One row per asked time (``ordinal`` keeps order and repeats), with the sample shown then or nulls."""
    return as_of(times, packets, keys, value)


def verify_key_packets(packets: DataFrame, determined: Column) -> DataFrame:
    """Corrects the type of packets that claim to be key by what the bitstream says (null: can't tell)."""
    return packets.withColumn("key", F.when(F.col("key"), F.coalesce(determined == "key", F.lit(True))).otherwise(F.col("key")))


def gop_index(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``gop``: how many key packets were decoded up to a packet."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return packets.withColumn("gop", F.sum(F.col("key").cast("long")).over(w))


def decode_times(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``dts``: within a group of pictures the i-th packet decoded takes the i-th least presentation time."""
    rows = gop_index(packets, keys)
    group = [*keys, "gop"]
    by_seq = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy("seq")))
    by_us = rows.select(*group, F.col("us").alias("dts"), F.row_number().over(Window.partitionBy(*group).orderBy("us", "seq")).alias("_i"))
    return by_seq.join(by_us, [*group, "_i"]).drop("_i")


def timestamp_errors(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``error``: a track must start with a key packet, no time may be negative, and none may lie before one of an earlier group."""
    rows = gop_index(packets, keys)
    # The greatest time of all groups before; one row per group.
    tops = rows.groupBy(*keys, "gop").agg(F.max("us").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("gop").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "gop", F.max("_top").over(before).alias("_before"))
    error = F.when(F.col("us") < 0, "negative").when(F.col("gop") == 0, "no_key_first").when(F.col("us") < F.col("_before"), "before_previous_group")
    return rows.join(tops, [*keys, "gop"]).withColumn("error", error).drop("_before")


def interleave(packets: DataFrame, group: Sequence[str], track: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Adds ``position``: the order in which a merge of the tracks' queues by their heads' times sends packets.

    A queue's head can't pass an earlier packet of its track, so a packet waits
    for the greatest time up to it; equal times go to the first track. A file's
    packets are numbered by time bucket, so a long file is many tasks.
    """
    reach = Window.partitionBy(*group, track).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = packets.withColumn("_reach", F.max("us").over(reach)).withColumn("_bucket", F.floor(F.col("_reach") / F.lit(bucket_us)).cast("long"))
    counts = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket")
    place = [*group, "_bucket"]
    before = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(place)], (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    order = Window.partitionBy(*place).orderBy("_reach", track, "seq")
    ranked = rows.withColumn("_own", F.row_number().over(order))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(place)]
    return ranked.join(before, same).select(*packets.columns, (F.col("_own") + F.col("_before")).alias("position"))

"""Aggregates over packets and segments. Times are whole microseconds; rates divide once, at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rates that are recognised.
SPECIAL_RATES = (24 / 1.001, 30 / 1.001, 60 / 1.001, 120 / 1.001)
COMMON_RATES = (12, 15, 20, 24, 25, 30, 48, 50, 60, 100, 120, 144, 240)
SPECIAL_TOLERANCE, COMMON_TOLERANCE = 0.0005, 0.025


def _stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    span = F.max(F.col("us") + F.col("dur")) - F.min("us")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("packet_count"), F.sum("bytes").alias("byte_count"), span.alias("span_us"))
    # A span of 0 has no rate: null, where floating point would give infinity.
    return sums.withColumns({
        "packet_rate": F.try_divide(F.col("packet_count") * F.lit(1e6), F.col("span_us").cast("double")),
        "bitrate": F.try_divide(F.col("byte_count") * F.lit(8e6), F.col("span_us").cast("double")),
    })


def packet_stats(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, bytes, span and rates of each track."""
    return _stats(packets, keys)


def packet_stats_prefix(packets: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """Statistics of each track's first packets: at least ``target``, up to one that starts where all before it have ended."""
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = packets.withColumns({"_n": F.count("*").over(before), "_end": F.max(F.col("us") + F.col("dur")).over(before)})
    stop = F.min(F.when((F.col("_n") >= target) & (F.col("us") >= F.col("_end")), F.col("seq"))).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop")))
    return _stats(kept, keys)


def track_duration(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The end of the packet that is presented last; another may end later."""
    return packets.groupBy(*keys).agg(F.max_by(F.col("us") + F.col("dur"), F.struct("us", "seq")).alias("duration_us"))


def file_duration(packets: DataFrame, file_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return track_duration(packets, [*file_keys, *keys]).groupBy(*file_keys).agg(F.coalesce(F.max("duration_us"), F.lit(0)).alias("duration_us"))


def first_timestamp(packets: DataFrame, file_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The least time among the tracks' first packets in decode order."""
    firsts = packets.groupBy(*file_keys, *keys).agg(F.min_by("us", "seq").alias("us"))
    return firsts.groupBy(*file_keys).agg(F.coalesce(F.min("us"), F.lit(0)).alias("first_us"))


def frame_metrics(packets: DataFrame, keys: Sequence[str], resolution: float = 1e6, fitted: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """Rates from the gaps between distinct times: least, greatest, average, and the median of instantaneous rates.

    A track with one time has the resolution (times a second) as every rate.
    fitted: keys and ``rate`` of tracks whose underlying rate is known (null:
    none); their gaps count in whole frames of it. target: only so many packets
    of a track, the first in decode order, are looked at.
    """
    if target is not None:
        first = Window.partitionBy(*keys).orderBy("seq")
        packets = packets.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= target)
    ticks = packets.select(*keys, "us").distinct()
    order = Window.partitionBy(*keys).orderBy("us")
    rows = ticks.withColumn("gap", F.col("us") - F.lag("us").over(order))
    if fitted is None:
        rows = rows.withColumn("unit", F.lit(float(resolution)))
    else:
        rows = rows.join(fitted.select(*keys, F.col("rate").alias("_rate")), list(keys), "left")
        frames = F.greatest(F.lit(1), F.floor(F.col("gap") / (F.lit(float(resolution)) / F.col("_rate")) + 0.5)).cast("long")
        rows = rows.withColumns({"gap": F.when(F.col("gap").isNotNull() & F.col("_rate").isNotNull(), frames).otherwise(F.col("gap")), "unit": F.coalesce("_rate", F.lit(float(resolution)))})
    by_gap = Window.partitionBy(*keys).orderBy("gap", "us")
    # The first time of a track has no gap; it sorts first and is not counted.
    ranked = rows.withColumns({"i": F.row_number().over(by_gap) - 1, "n": F.count("*").over(Window.partitionBy(*keys)) - 1})
    middle = lambda i: F.max(F.when(F.col("i") == i, F.col("gap")))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    sums = ranked.groupBy(*keys).agg(
        (F.max("n") + 1).alias("frames"), F.max("unit").alias("unit"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.sum("gap").alias("total"), F.max("n").alias("n"), middle(low).alias("m1"), middle(high).alias("m2")
    )
    only = lambda c: F.when(F.col("n") == 0, F.lit(float(resolution))).otherwise(c)
    rate = lambda gap: F.try_divide(F.col("unit"), gap.cast("double"))
    return sums.select(
        *keys,
        "frames",
        only(rate(F.col("most"))).alias("min_rate"),
        only(rate(F.col("least"))).alias("max_rate"),
        only(F.try_divide(F.col("n") * F.col("unit"), F.col("total").cast("double"))).alias("avg_rate"),
        only((rate(F.col("m1")) + rate(F.col("m2"))) / 2).alias("median_rate"),
        F.coalesce(F.col("least") == F.col("most"), F.lit(True)).alias("constant"),
    )


def best_guess_rate(rate: Column) -> Column:
    """The recognised rate near this one, or itself."""
    error = lambda c: F.abs(F.lit(float(c)) / rate - 1)
    special = F.coalesce(*[F.when(error(c) <= SPECIAL_TOLERANCE, F.lit(float(c))) for c in SPECIAL_RATES])
    near = F.array_min(F.filter(F.array(*[F.struct(error(c).alias("e"), F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(COMMON_RATES)]), lambda x: x["e"] <= COMMON_TOLERANCE))
    return F.coalesce(special, near["c"], rate)


def peak_bitrate(segments: DataFrame, keys: Sequence[str], target_us: int) -> DataFrame:
    """Peak and average bit rate of playlists: the peak is the largest over runs of segments that last 0.5 to 1.5 targets.

    ``i`` numbers a playlist's segments from 0. A run is a pair of its first
    and last segment; only pairs within 1.5 targets are joined, by buckets of
    that width, so pairs grow with segments and not with their square.
    """
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = segments.withColumns({"_t": F.sum("dur").over(upto), "_b": F.sum("bytes").over(upto)})
    width = 3 * target_us // 2
    bucket = lambda c: F.floor(c / width).cast("long")
    start, end = F.col("_t") - F.col("dur"), F.col("_t")
    first = sums.select(*keys, F.col("i").alias("a"), start.alias("t0"), (F.col("_b") - F.col("bytes")).alias("b0"), F.explode(F.array(bucket(start), bucket(start) + 1)).alias("_k"))
    last = sums.select(*keys, F.col("i").alias("b"), end.alias("t1"), F.col("_b").alias("b1"), bucket(end).alias("_k"))
    runs = first.join(last, [*keys, "_k"]).filter((F.col("a") <= F.col("b")) & (2 * (F.col("t1") - F.col("t0")) >= target_us) & (2 * (F.col("t1") - F.col("t0")) <= 3 * target_us))
    peak = runs.groupBy(*keys).agg(F.max((F.col("b1") - F.col("b0")) * F.lit(8e6) / (F.col("t1") - F.col("t0")).cast("double")).alias("peak"))
    alone = F.when(F.col("dur") == 0, F.lit(1_000_000)).otherwise(F.col("dur"))
    total = segments.groupBy(*keys).agg(
        F.max(F.col("bytes") * F.lit(8e6) / alone.cast("double")).alias("single"), F.sum("bytes").alias("bytes"), F.sum("dur").alias("dur")
    )
    whole = F.when(F.col("dur") == 0, F.lit(1_000_000)).otherwise(F.col("dur"))
    return total.join(peak, list(keys), "left").select(
        *keys, F.when(F.coalesce("peak", F.lit(0.0)) > 0, F.col("peak")).otherwise(F.col("single")).alias("peak_bitrate"), (F.col("bytes") * F.lit(8e6) / whole.cast("double")).alias("average_bitrate")
    )


def progress(packets: DataFrame, keys: Sequence[str], total_us: int) -> DataFrame:
    """The share of the whole that the slowest track has reached."""
    ends = packets.groupBy(*keys).agg(F.max(F.col("us") + F.col("dur")).alias("end"))
    return ends.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("end") / F.lit(float(total_us)))).alias("progress"))


def mime_type(tracks: DataFrame, keys: Sequence[str], container: Column) -> DataFrame:
    """MIME type of each file with its distinct codec strings in track order."""
    codecs = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "codec_string"))), lambda x: x["codec_string"]))
    return tracks.withColumn("_c", container).groupBy(*keys).agg(F.first("_c").alias("_c"), codecs.alias("_s")).select(
        *keys, F.when(F.size("_s") > 0, F.concat("_c", F.lit('; codecs="'), F.array_join("_s", ", "), F.lit('"'))).otherwise(F.col("_c")).alias("mime_type")
    )

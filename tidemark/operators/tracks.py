"""Queries over track rows: filter and sort, the primary track, pairing, variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dealing import join_blocks


def asc(c: Column) -> Column:
    """Least first; null last."""
    return c.asc_nulls_last()


def desc(c: Column) -> Column:
    """Greatest first; null last."""
    return c.desc_nulls_last()


def prefer(c: Column) -> Column:
    """True first."""
    return F.coalesce(c, F.lit(False)).desc()


class TrackQuery:
    """A filter and sort keys; ``merge`` joins filters by AND and appends the other's keys."""

    def __init__(self, filter: Column | None = None, sort_by: Sequence[Column] = ()):  # noqa: A002
        self.filter, self.sort_by = filter, list(sort_by)

    def merge(self, other: TrackQuery) -> TrackQuery:
        both = [f for f in (self.filter, other.filter) if f is not None]
        return TrackQuery(None if not both else both[0] if len(both) == 1 else both[0] & both[1], [*self.sort_by, *other.sort_by])

    def apply(self, tracks: DataFrame, ordinal: str = "ordinal", by: Sequence[str] = ()) -> DataFrame:
        """The tracks that pass, with ``rank``; equal keys keep the order of the file."""
        rows = tracks if self.filter is None else tracks.filter(self.filter)
        order = Window.partitionBy(*by).orderBy(*self.sort_by, ordinal)
        return rows.withColumn("rank", F.row_number().over(order))

    def first(self, tracks: DataFrame, by: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
        return self.apply(tracks, ordinal, by).filter("rank = 1").drop("rank")


def pairs(a: DataFrame, b: DataFrame, file: str, track: str, members: str) -> DataFrame:
    """Tracks of one file that can be played together: different ones that share a bit of their ``members`` arrays.

    Joined on the shared bit, so tracks that share none never meet. A pair that
    shares several is kept at the least of them, so that pairs need no
    comparison with each other; a bit's tracks are dealt in blocks.
    """

    def each(t: DataFrame, name: str) -> DataFrame:
        bits = t.groupBy(file, F.col(track).alias(name)).agg(F.array_distinct(F.flatten(F.collect_list(members))).alias(f"_of_{name}"))
        return bits.withColumn("_m", F.explode(f"_of_{name}"))

    met = join_blocks(each(a, "a"), each(b, "b"), [file, "_m"], "a")
    return met.filter((F.col("a") != F.col("b")) & (F.col("_m") == F.array_min(F.array_intersect("_of_a", "_of_b")))).select(file, "a", "b")


def has_pairable(a: DataFrame, b: DataFrame, file: str, track: str, members: str) -> DataFrame:
    """Tracks of a with a partner in b."""
    left = a.withColumn("_m", F.explode(members))
    right = b.select(file, F.col(track).alias("_t"), F.explode(members).alias("_m")).groupBy(file, "_m").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    # A group holds another track than this one if its least or greatest differs.
    hit = left.join(right, [file, "_m"]).filter((F.col("_lo") != F.col(track)) | (F.col("_hi") != F.col(track)))
    return hit.select(*a.columns).distinct()


def primary_track(tracks: DataFrame, by: Sequence[str], query: TrackQuery | None = None, pairable: Column | None = None) -> DataFrame:
    """The track to play: the caller's keys, then default, pairable, not only key packets, highest bit rate, file order."""
    keys = [prefer(F.col("is_default"))]
    if pairable is not None:
        keys.append(prefer(pairable))
    keys += [prefer(~F.col("only_key")), desc(F.col("bitrate"))]
    return (query or TrackQuery()).merge(TrackQuery(sort_by=keys)).first(tracks, by)


def variant_dedupe(variants: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per playlist that several variants name: their bits or-ed, default if any is, least and greatest bit rate."""
    return variants.groupBy(*key).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(variant as int))")).alias("mask"), F.bool_or("is_default").alias("is_default"), F.min("bitrate").alias("least"), F.max("bitrate").alias("most"), F.count("*").alias("variants")
    )


def display_size(rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height as shown."""
    upright = F.pmod(rotation, F.lit(180)) == 0
    return F.when(upright, width).otherwise(height), F.when(upright, height).otherwise(width)


def is_high_dynamic_range(primaries: Column, transfer: Column, matrix: Column) -> Column:
    parts = primaries.isin("bt2020", "smpte432"), transfer.isin("pq", "hlg"), matrix == "bt2020-ncl"
    return F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False)) | F.coalesce(parts[2], F.lit(False))

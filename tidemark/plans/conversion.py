"""Conversion plans: which tracks go into an output, copied or transcoded, and why others don't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Codecs in the order in which encoders prefer them.
VIDEO_CODECS = ("avc", "hevc", "vp9", "av1", "vp8", "prores")
AUDIO_CODECS = ("aac", "opus", "mp3", "vorbis", "flac", "ac3", "eac3", "dts")
PCM_CODECS = ("pcm-s16", "pcm-s16be", "pcm-s24", "pcm-s24be", "pcm-s32", "pcm-s32be", "pcm-f32", "pcm-f32be", "pcm-f64", "pcm-f64be", "pcm-u8", "pcm-s8", "ulaw", "alaw")
SUBTITLE_CODECS = ("webvtt",)
_MKV_PCM = tuple(c for c in PCM_CODECS if c not in ("pcm-s8", "pcm-f32be", "pcm-f64be", "ulaw", "alaw"))
_MP4_PCM = tuple(c for c in PCM_CODECS if c not in ("pcm-u8", "pcm-s8", "ulaw", "alaw"))

#: What each container holds: video, audio and subtitle codecs, tracks per type and in all, rotation and timestamps kept.
FORMATS: dict[str, tuple] = {
    "mp4": (VIDEO_CODECS, AUDIO_CODECS + _MP4_PCM, ("webvtt",), {}, 2**31 - 1, True, True),
    "cmaf": (VIDEO_CODECS, AUDIO_CODECS + _MP4_PCM, ("webvtt",), {}, 2**31 - 1, True, True),
    "mov": (VIDEO_CODECS, AUDIO_CODECS + PCM_CODECS, (), {}, 2**31 - 1, True, True),
    "mkv": (VIDEO_CODECS, AUDIO_CODECS + _MKV_PCM, ("webvtt",), {}, 127, False, True),
    "webm": (("vp8", "vp9", "av1"), ("opus", "vorbis"), ("webvtt",), {}, 127, False, True),
    "mp3": ((), ("mp3",), (), {"audio": 1}, 1, False, False),
    "wav": ((), ("pcm-s16", "pcm-s24", "pcm-s32", "pcm-f32", "pcm-f64", "pcm-u8", "ulaw", "alaw"), (), {"audio": 1}, 1, False, False),
    "ogg": ((), ("vorbis", "opus"), (), {}, 2**31 - 1, False, False),
    "adts": ((), ("aac",), (), {"audio": 1}, 1, False, False),
    "flac": ((), ("flac",), (), {"audio": 1}, 1, False, False),
    "hls": (VIDEO_CODECS, AUDIO_CODECS + _MP4_PCM, ("webvtt",), {}, 2**31 - 1, False, True),
    "mpegts": (("avc", "hevc"), ("aac", "mp3", "ac3", "eac3", "dts"), (), {"video": 16, "audio": 32}, 48, False, True),
}


def formats(spark: SparkSession) -> DataFrame:
    """The containers as a small table."""
    rows = [(n, list(v), list(a), list(s), limits.get("video"), limits.get("audio"), total, rotation, timed) for n, (v, a, s, limits, total, rotation, timed) in FORMATS.items()]
    return spark.createDataFrame(rows, "format string, video array<string>, audio array<string>, subtitle array<string>, max_video int, max_audio int, max_tracks int, rotation boolean, timestamped boolean")


#: Formats that hold nothing but one audio track; the others need a track of any type.
ONE_AUDIO = ("mp3", "wav", "adts", "flac")


def has_enough_tracks(tracks: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """by, enough: whether an output in this format has the tracks that it needs. tracks: by and type; a null type is an output without tracks."""
    wanted = F.count_if(F.col("type") == "audio") if target in ONE_AUDIO else F.count("type")
    return tracks.groupBy(*by).agg((wanted >= 1).alias("enough"))


def discard(tracks: DataFrame, by: Sequence[str], most: dict[str, int], total: int, encodable: Column) -> DataFrame:
    """Adds ``reason``: why a track is left out (null: it is used).

    The user's choice comes first, then what can't be read or written; tracks
    that remain are counted in file order against the limits.
    """
    early = F.when(F.col("discard"), "discarded_by_user").when(F.col("codec").isNull(), "unknown_source_codec").when(~encodable, "no_encodable_target_codec")
    rows = tracks.withColumn("_early", early)
    counted = F.when(F.col("_early").isNull(), 1).otherwise(0)
    order = lambda *k: Window.partitionBy(*k).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    of_type = F.sum(counted).over(order(*by, "type"))
    limit = F.lit(2**31 - 1)
    for kind, n in most.items():
        limit = F.when(F.col("type") == kind, F.lit(n)).otherwise(limit)
    rows = rows.withColumn("_over_type", of_type > limit)
    kept = F.when(F.col("_early").isNull() & ~F.col("_over_type"), 1).otherwise(0)
    rows = rows.withColumn("_over", F.sum(kept).over(order(*by)) > total)
    reason = F.coalesce(F.col("_early"), F.when(F.col("_over_type"), "max_track_count_of_type_reached"), F.when(F.col("_over"), "max_track_count_reached"))
    return rows.withColumn("reason", reason).drop("_early", "_over_type", "_over")


def plan(tracks: DataFrame, options: DataFrame, target: str, by: Sequence[str] = ("file_id",)) -> DataFrame:
    """One row per output track: ``action`` (copy, transcode or discard), target codec and size, reason.

    options: type, option (numbering several outputs of one track), discard, codec, width, height, force.
    """
    video, audio, subtitle, most, total, rotation, timed = FORMATS[target]
    allowed = {"video": video, "audio": audio, "subtitle": subtitle}
    rows = tracks.join(options, "type", "left").withColumns({"discard": F.coalesce("discard", F.lit(False)), "option": F.coalesce("option", F.lit(0))})
    fits = F.lit(False)
    first = F.lit(None).cast("string")
    for kind, names in allowed.items():
        names_ = list(names) or [""]
        fits = F.when(F.col("type") == kind, F.col("codec").isin(names_)).otherwise(fits)
        if names:
            first = F.when(F.col("type") == kind, F.lit(names[0])).otherwise(first)
    wanted = F.coalesce(F.col("target_codec"), F.when(fits, F.col("codec")), first)
    ok = F.lit(False)
    for kind, names in allowed.items():
        ok = F.when(F.col("type") == kind, wanted.isin(list(names) or [""])).otherwise(ok)
    rows = rows.withColumns({"_wanted": wanted, "_ok": F.coalesce(ok, F.lit(False))})
    rows = discard(rows.withColumn("ordinal", F.col("ordinal") * 1000 + F.col("option")), by, most, total, F.col("_ok"))
    turned = F.coalesce(F.col("rotation") % 360 != 0, F.lit(False)) & F.lit(not rotation)
    resized = (F.col("width").isNotNull() & (F.col("width") != F.col("coded_width"))) | (F.col("height").isNotNull() & (F.col("height") != F.col("coded_height")))
    again = F.coalesce(F.col("force"), F.lit(False)) | (F.col("_wanted") != F.col("codec")) | F.coalesce(resized, F.lit(False)) | turned
    action = F.when(F.col("reason").isNotNull(), "discard").when(again, "transcode").otherwise("copy")
    # One missing dimension follows from the other, kept even.
    even = lambda x: (F.floor(x / 2 + 0.5) * 2).cast("int")
    w = F.coalesce(F.col("width"), even(F.col("height") * F.col("coded_width") / F.col("coded_height")), F.col("coded_width"))
    h = F.coalesce(F.col("height"), even(F.col("width") * F.col("coded_height") / F.col("coded_width")), F.col("coded_height"))
    return rows.select(*by, "track_id", "type", "option", "codec", F.when(F.col("reason").isNull(), F.col("_wanted")).alias("output_codec"), action.alias("action"), "reason", w.alias("output_width"), h.alias("output_height"), F.lit(not timed).alias("pad_start"))


def explain_invalid(plan_: DataFrame, by: Sequence[str] = ("file_id",)) -> DataFrame:
    """Files from which nothing is used, with the reasons and how often each occurs."""
    counts = plan_.groupBy(*by, "reason").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("used"), F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("reasons")).filter("used = 0").drop("used")

"""Which playlists a file's tracks become: variants, and the groups of audio that they refer to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dealing import join_blocks


def arrange(tracks: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, video, audio, grouped: one row per variant of a file.

    tracks: by, track, type, codec, only_key; pairs: by, a, b, tracks that can go
    together, each way or one. A video track that isn't made of key frames only
    is a variant for each codec among its audio tracks, in ascending order of
    ids. If it has one audio track, which goes with no other video, both share
    a playlist (``grouped`` is false); otherwise the audio tracks are a group of
    their own playlists. Tracks that go with none are variants alone; audio
    that goes with some video isn't one.
    """
    keys = list(by)
    video = tracks.filter("type = 'video'").select(*keys, F.col("track").alias("video"), F.coalesce("only_key", F.lit(False)).alias("only_key"))
    audio = tracks.filter("type = 'audio'").select(*keys, F.col("track").alias("sound"), "codec")
    both = pairs.select(*keys, "a", "b").unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = both.join(video.filter("not only_key").select(*keys, F.col("video").alias("a")), [*keys, "a"]).join(audio.select(*keys, F.col("sound").alias("b"), "codec"), [*keys, "b"])
    # A track has few partners: the lists are as long as a file has audio tracks.
    groups = edges.groupBy(*keys, "a", "codec").agg(F.sort_array(F.collect_list("b")).alias("audio"))
    videos = edges.groupBy(*keys, "b").agg(F.count("*").alias("videos"))
    single = edges.groupBy(*keys, "a").agg(F.count("*").alias("sounds"), F.min("b").alias("b")).join(videos, [*keys, "b"]).select(*keys, "a", ((F.col("sounds") == 1) & (F.col("videos") == 1)).alias("alone"))
    paired = groups.join(single, [*keys, "a"]).select(*keys, F.col("a").alias("video"), "audio", (~F.col("alone")).alias("grouped"))
    none = F.array().cast(paired.schema["audio"].dataType)
    lone_video = video.join(edges.select(*keys, F.col("a").alias("video")).distinct(), [*keys, "video"], "left_anti").select(*keys, "video", none.alias("audio"), F.lit(False).alias("grouped"))
    lone_audio = audio.join(edges.select(*keys, F.col("b").alias("sound")).distinct(), [*keys, "sound"], "left_anti")
    lone_audio = lone_audio.select(*keys, F.lit(None).cast(paired.schema["video"].dataType).alias("video"), F.array("sound").alias("audio"), F.lit(False).alias("grouped"))
    return paired.unionByName(lone_video).unionByName(lone_audio)


def arrange_alike(tracks: DataFrame, by: Sequence[str], meet: str) -> DataFrame:
    """As arrange, where a video and an audio track go together if their ``meet`` columns are equal (null: with none).

    No pair is listed: the audio tracks that meet are gathered once by codec,
    and each video track takes the lists. The result is as long as all lists,
    but nothing else is.
    """
    keys = list(by)
    place = [*keys, "_m"]
    video = tracks.filter("type = 'video'").select(*keys, F.col("track").alias("video"), F.coalesce("only_key", F.lit(False)).alias("only_key"), F.col(meet).alias("_m"))
    audio = tracks.filter("type = 'audio'").select(*keys, F.col("track").alias("sound"), "codec", F.col(meet).alias("_m"))
    moving = video.filter("not only_key").select(*place, "video")
    videos = moving.groupBy(*place).agg(F.count("*").alias("_videos"))
    sounds = audio.groupBy(*place).agg(F.count("*").alias("_sounds"))
    met = videos.join(sounds, place).select(*place, ((F.col("_sounds") != 1) | (F.col("_videos") != 1)).alias("grouped"))
    # A list is as long as a file has audio tracks of one codec that meet.
    lists = audio.groupBy(*place, "codec").agg(F.sort_array(F.collect_list("sound")).alias("audio")).join(met, place)
    paired = join_blocks(moving, lists, place, "video").select(*keys, "video", "audio", "grouped")
    none = F.array().cast(paired.schema["audio"].dataType)
    lone_video = video.join(met.select(*place, F.lit(True).alias("_met")), place, "left").filter("only_key or _met is null").select(*keys, "video", none.alias("audio"), F.lit(False).alias("grouped"))
    lone_audio = audio.join(met.select(*place), place, "left_anti")
    lone_audio = lone_audio.select(*keys, F.lit(None).cast(paired.schema["video"].dataType).alias("video"), F.array("sound").alias("audio"), F.lit(False).alias("grouped"))
    return paired.unionByName(lone_video).unionByName(lone_audio)

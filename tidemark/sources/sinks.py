"""Tables of tracks and packets back to media files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import isobmff, matroska, mpeg_audio, mpegts, ogg_file, wave_file
from .checksums import crc8, crc16
from .model import MediaError, Packet, Track
from .tags import build_id3v2, build_vorbis_comments

TRACK_COLUMNS = ["file_id", "track_id", "type", "codec", "time_resolution", "language", "name", "decoder_description", "coded_width", "coded_height", "rotation", "channels", "sample_rate", "is_default", "ordinal"]
#: Bytes of files that are sent on at once.
FILES_BYTES = 4_000_000
PACKET_COLUMNS = ["file_id", "track_id", "seq", "type", "pts_ticks", "duration", "data"]


def build_mp3(packets: list[bytes], tags: dict[str, str] | None = None, xing: bool = True) -> bytes:
    """Frames after a tag and, unless turned off, a frame that tells how many there are."""
    head = build_id3v2(tags) if tags else b""
    if not xing or not packets or (h := mpeg_audio.mp3_header(packets[0], 0)) is None:
        return head + b"".join(packets)
    side = (9 if h["channels"] == 1 else 17) if h["low"] else (17 if h["channels"] == 1 else 32)
    kind = "Info" if len({mpeg_audio.mp3_header(p, 0)["bitrate"] for p in packets if mpeg_audio.mp3_header(p, 0)}) == 1 else "Xing"
    body = bytearray(h["size"])
    body[:4] = packets[0][:4]
    body[4 + side : 4 + side + 16] = kind.encode() + struct.pack(">III", 3, len(packets), sum(map(len, packets)) + len(body))
    return head + bytes(body) + b"".join(packets)


def build_flac(description: bytes, packets: list[bytes], tags: dict[str, str] | None = None) -> bytes:
    """Frames after the stream's information (of ``description``: what stands before its first frame) and the tags."""
    at = 4 if description[:4] == b"fLaC" else 0
    info = description[at + 4 : at + 38] if description[at] & 127 == 0 and len(description) >= at + 38 else description[:34]
    comments = build_vorbis_comments(tags or {})
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(comments).to_bytes(3, "big") + comments + b"".join(packets)


def flac_frame(number: int, block_code: int, body: bytes) -> bytes:
    """A frame around a body that is already coded: header, checksums. Stereo, 16 bit, 44.1 kHz, up to 128 frames."""
    h = bytes([0xFF, 0xF8, block_code << 4 | 9, 0x18, number & 127])
    whole = h + bytes([crc8(h)]) + body
    return whole + struct.pack(">H", crc16(whole))


def mux(format_: str, tracks: list[Track], payloads: dict[int, list[bytes]], tags: dict[str, str] | None = None) -> bytes:
    """One file of this format."""
    one = tracks[0] if tracks else None
    if format_ in ("mp4", "mov"):
        return isobmff.build(tracks, payloads, tags)
    if format_ == "cmaf":
        return isobmff.build_fragmented(tracks, payloads, tags)
    if format_ in ("mkv", "webm"):
        return matroska.build(tracks, payloads, tags, webm=format_ == "webm")
    if format_ == "mpegts":
        wrapped = {t.track_id: [mpeg_audio.build_adts([p], t.description) if t.codec == "aac" and t.description else p for p in payloads[t.track_id]] for t in tracks}
        return mpegts.build(tracks, wrapped)
    if one is None or len(tracks) > 1:
        raise MediaError(f"{format_} holds exactly one track")
    body = payloads[one.track_id]
    if format_ == "wav":
        return wave_file.build(one.codec, one.channels, one.sample_rate, b"".join(body), tags)
    if format_ == "adts":
        return mpeg_audio.build_adts(body, one.description)
    if format_ == "mp3":
        return build_mp3(body, tags)
    if format_ == "flac":
        return build_flac(one.description, body, tags)
    if format_ == "ogg":
        ends = [p.ticks + p.duration_ticks for p in one.packets]
        info = (b"OpusTags" if one.codec == "opus" else b"\3vorbis") + build_vorbis_comments(tags or {}) + (b"" if one.codec == "opus" else b"\1")
        return ogg_file.build([one.description, info], list(zip(body, ends, strict=True)))
    raise MediaError(f"no writer for {format_}")


def write_media(tracks: DataFrame, packets: DataFrame, format_: str) -> DataFrame:
    """file_id, content, length: one row per file. A file is one task's work; a file without packets is written too."""

    def written(name: str | None, made: list[Track], payloads: dict[int, list[bytes]]) -> tuple[str | None, bytes]:
        return name, mux(format_, made, payloads)

    def batch_of(held: list[tuple[str | None, bytes]]) -> pa.RecordBatch:
        names, contents = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary()), pa.array(map(len, contents), pa.int64())], names=["file_id", "content", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A file's tracks come first, in order, then its packets: a file is written when the next one begins.
        name, made, payloads, by, started = None, [], {}, {}, False
        held, size = [], 0
        for batch in batches:
            head, *rest = (batch.column(c).to_pylist() for c in ("file_id", "_track", "track_id", "type", "pts_ticks", "duration", "data"))
            for one, r, track_id, kind, ticks, duration, data in zip(head, *rest, strict=True):
                if not started or one != name:
                    if started:
                        held.append(written(name, made, payloads))
                        size += len(held[-1][1])
                        if size > FILES_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                    name, made, payloads, by, started = one, [], {}, {}, True
                if r is not None:
                    made.append(Track(track_id, r["type"], r["codec"], r["time_resolution"], language=r["language"] or "und", name=r["name"], description=r["decoder_description"], width=r["coded_width"], height=r["coded_height"], rotation=r["rotation"] or 0, channels=r["channels"], sample_rate=r["sample_rate"], default=bool(r["is_default"])))
                    payloads[track_id], by[track_id] = [], made[-1]
                else:
                    track = by[track_id]
                    track.packets.append(Packet(len(track.packets), ticks, round((duration or 0) * track.resolution), 0, len(data), kind == "key"))
                    payloads[track_id].append(data)
        if started:
            held.append(written(name, made, payloads))
        if held:
            yield batch_of(held)

    about = F.struct(*[c for c in TRACK_COLUMNS if c not in ("file_id", "track_id")])
    first = tracks.select("file_id", "track_id", about.alias("_track"), F.col("ordinal").cast("long").alias("_order"))
    later = packets.select(*PACKET_COLUMNS, F.col("track_id").cast("long").alias("_order"))
    both = first.unionByName(later, allowMissingColumns=True)
    # As for a cogroup, a file's rows are dealt to one task and sorted there, but they come as one stream.
    rows = both.repartition("file_id").sortWithinPartitions("file_id", F.col("_track").isNull(), "_order", "seq")
    return rows.select("file_id", "_track", "track_id", "type", "pts_ticks", "duration", "data").mapInArrow(run, "file_id string, content binary, length long")


def save_files(files: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes each row's content to folder/name, in any store that pyarrow reaches, by a rename; returns path and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            paths, sizes = [], []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                store.create_dir(base, recursive=True)
                aside = f"{base}/.{n}-{uuid.uuid4().hex}"
                data = c.as_py()
                with store.open_output_stream(aside) as out:
                    out.write(data)
                store.move(aside, f"{base}/{n}")
                paths.append(f"{base}/{n}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return files.select(F.col(name).cast("string"), "content").mapInArrow(run, "path string, length long")


def master_playlist(variants: list[dict], renditions: list[dict] = ()) -> str:
    """A master playlist: variants have path, bandwidth, average_bandwidth, codecs, width, height, frame_rate, audio; renditions type, group_id, name, language, path, default."""
    lines = ["#EXTM3U", "#EXT-X-VERSION:3", "#EXT-X-INDEPENDENT-SEGMENTS", ""]
    for r in renditions:
        part = [f"TYPE={r['type'].upper()}", f'GROUP-ID="{r["group_id"]}"', f'NAME="{r["name"]}"']
        if r.get("language"):
            part.append(f'LANGUAGE="{r["language"]}"')
        part.append(f"DEFAULT={'YES' if r.get('default') else 'NO'}")
        if r.get("path"):
            part.append(f'URI="{r["path"]}"')
        lines.append("#EXT-X-MEDIA:" + ",".join(part))
    for v in variants:
        part = [f"BANDWIDTH={v['bandwidth']}"]
        if v.get("average_bandwidth"):
            part.append(f"AVERAGE-BANDWIDTH={v['average_bandwidth']}")
        if v.get("codecs"):
            part.append(f'CODECS="{",".join(v["codecs"])}"')
        if v.get("width") and v.get("height"):
            part.append(f"RESOLUTION={v['width']}x{v['height']}")
        if v.get("frame_rate"):
            part.append(f"FRAME-RATE={v['frame_rate']:.3f}")
        if v.get("audio"):
            part.append(f'AUDIO="{v["audio"]}"')
        lines += ["#EXT-X-STREAM-INF:" + ",".join(part), v["path"]]
    return "\n".join(lines) + "\n"


def _stem(c: Column) -> Column:
    """A file's name by its id."""
    return F.substring(F.md5(c.cast("binary")), 1, 12)


def hls_segments(tracks: DataFrame, packets: DataFrame, target_us: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The segments of write_hls (file_id, name, content), and what is known before they are written (file_id, i, path, seconds, span)."""
    from ..operators import packets as pk
    from ..operators import timeline

    rows = packets.withColumns({"us": F.floor(F.col("timestamp") * 1e6 + 0.5).cast("long"), "key": F.col("type") == "key", "dur": F.floor(F.col("duration") * 1e6 + 0.5).cast("long")})
    lead = tracks.groupBy("file_id").agg(F.min_by("track_id", F.struct(F.col("type") != "video", "ordinal")).alias("track_id"))
    leading = rows.join(lead, ["file_id", "track_id"])
    cut = timeline.segment_greedy(leading, ["file_id", "track_id"], target_us)
    starts = cut.groupBy("file_id", "segment").agg(F.min("us").alias("us"), F.max(F.col("us") + F.col("dur")).alias("end"))
    dealt = pk.as_of(rows.select("file_id", "track_id", "seq", "us"), starts.select("file_id", "us", "segment"), ["file_id"], ["segment"])
    dealt = dealt.select("file_id", "track_id", "seq", F.coalesce("segment", F.lit(0)).cast("long").alias("_follows"))
    mine = cut.select("file_id", "track_id", "seq", F.col("segment").alias("_leads"))
    keys = ["file_id", "track_id", "seq"]
    parts = rows.join(dealt, keys).join(mine, keys, "left").withColumn("segment", F.coalesce("_leads", "_follows"))
    name = F.concat(_stem(F.col("file_id")), F.lit("-"), F.col("segment"), F.lit(".ts"))
    made = parts.select(F.col("file_id").alias("_file"), "segment", name.alias("file_id"), *[c for c in PACKET_COLUMNS if c != "file_id"])
    of = made.select("_file", "file_id").distinct().join(tracks.withColumnRenamed("file_id", "_file"), "_file")
    segments = write_media(of.select(*TRACK_COLUMNS), made, "mpegts").select(F.col("file_id").alias("name"), "content")
    listed = made.select("_file", F.col("file_id").alias("name")).distinct()
    segments = segments.join(listed, "name").select(F.col("_file").alias("file_id"), "name", "content")
    order = Window.partitionBy("file_id").orderBy("segment")
    timed = starts.withColumn("span", F.coalesce(F.lead("us").over(order), F.col("end")) - F.col("us"))
    info = timed.select("file_id", F.col("segment").alias("i"), F.concat(_stem(F.col("file_id")), F.lit("-"), F.col("segment"), F.lit(".ts")).alias("path"), F.format_string("%.6f", F.col("span") / 1e6).alias("seconds"), "span")
    return segments, info


def write_hls(tracks: DataFrame, packets: DataFrame, target_us: int = 2_000_000) -> DataFrame:
    """file_id, name, content: every file as a playlist of transport-stream segments, which all its tracks share, and a master playlist.

    The first video track (without one, the first track) is cut at key packets;
    the others are cut where it is. tracks and packets are as media.tracks and
    media.packets give them. A file is named by a hash of its id.
    """
    from . import hls

    segments, info = hls_segments(tracks, packets, target_us)
    top = info.groupBy("file_id").agg(F.ceil(F.max("span") / 1e6).cast("long").alias("target"))
    lists = hls.media_playlist(info, ["file_id"], top).select("file_id", F.concat(_stem(F.col("file_id")), F.lit(".m3u8")).alias("name"), F.col("playlist").cast("binary").alias("content"))
    sizes = segments.select("file_id", "name", F.octet_length("content").alias("n")).join(info.select("file_id", F.col("path").alias("name"), "span"), ["file_id", "name"])
    rates = sizes.groupBy("file_id").agg(
        F.max(F.ceil(F.col("n") * 8e6 / F.greatest("span", F.lit(1)))).cast("long").alias("peak"), F.ceil(F.sum("n") * 8e6 / F.greatest(F.sum("span"), F.lit(1))).cast("long").alias("mean")
    )
    line = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-INDEPENDENT-SEGMENTS\n\n#EXT-X-STREAM-INF:BANDWIDTH="), "peak", F.lit(",AVERAGE-BANDWIDTH="), "mean", F.lit("\n"), _stem(F.col("file_id")), F.lit(".m3u8\n"))
    masters = rates.select("file_id", F.concat(_stem(F.col("file_id")), F.lit("-master.m3u8")).alias("name"), line.cast("binary").alias("content"))
    return segments.unionByName(lists).unionByName(masters)

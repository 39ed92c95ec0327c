"""HTTP live streaming playlists: media and master playlists as rows, and rows as playlists."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import join_path

SEGMENT_COLUMNS = [
    ("playlist", pa.string()), ("seq_no", pa.int64()), ("start", pa.float64()), ("duration", pa.float64()), ("unix_start", pa.float64()), ("path", pa.string()), ("byte_offset", pa.int64()),
    ("byte_length", pa.int64()), ("discontinuity", pa.int32()), ("init_path", pa.string()), ("enc_method", pa.string()), ("key_uri", pa.string()), ("iv", pa.string()), ("ended", pa.bool_()), ("target_duration", pa.float64()),
]
SEGMENT_SCHEMA = "playlist string, seq_no long, start double, duration double, unix_start double, path string, byte_offset long, byte_length long, discontinuity int, init_path string, enc_method string, key_uri string, iv string, ended boolean, target_duration double"


class PlaylistError(ValueError):
    """A playlist that can't be read."""


def attributes(text: str) -> dict[str, str]:
    """KEY=value pairs separated by commas outside quotes; keys in lower case."""
    found = {}
    for part in re.findall(r'(?:[^,"]|"[^"]*"?)+', text):
        key, _, value = part.partition("=")
        if key.strip():
            found[key.strip().lower()] = value.replace('"', "")
    return found


def lines_of(text: str) -> list[str]:
    lines = [x for x in (y.strip() for y in re.split(r"\r\n|\r|\n", text)) if x and (not x.startswith("#") or x.startswith("#EXT"))]
    if not lines or lines[0] != "#EXTM3U":
        raise PlaylistError("the first line must be #EXTM3U")
    return lines[1:]


def _number(value: str, what: str, kind=float):
    try:
        n = kind(value)
    except ValueError:
        n = math.nan
    if not math.isfinite(n) or n < 0:
        raise PlaylistError(f"{what}: {value!r}")
    return n


def _range(value: str) -> tuple[int, int | None]:
    length, at, offset = value.partition("@")
    return _number(length, "byte range length", int), _number(offset, "byte range offset", int) if at else None


def _date(value: str) -> float | None:
    try:
        d = datetime.datetime.fromisoformat(value)
    except ValueError:
        return None
    return (d if d.tzinfo else d.replace(tzinfo=datetime.UTC)).timestamp()


def parse_media_playlist(path: str, text: str, offset_by_date: bool = True) -> list[dict]:
    """The segments of a media playlist.

    A date snaps the time line to Unix time, and dates the segments before it;
    a repeated date is ignored. Without dates, and with a media sequence above
    0, the first segment starts at sequence times target duration.
    """
    out: list[dict] = []
    now, unix, dated = 0.0, None, None
    seq, group, target = 0, 0, None
    duration = init = key = None
    piece: tuple[int, int] | None = None
    piece_end = None
    started = ended = False
    for line in lines_of(text):
        tag, _, value = line.partition(":")
        if not line.startswith("#"):
            if duration is None:
                raise PlaylistError("a segment must follow #EXTINF")
            use = dict(key) if key else {}
            if use.get("method") == "AES-128" and use.get("iv") is None:
                use["iv"] = f"{seq:032x}"
            out.append({
                "playlist": path, "seq_no": seq, "start": now, "duration": duration, "unix_start": unix, "path": join_path(path, line), "byte_offset": piece[0] if piece else 0, "byte_length": piece[1] if piece else None,
                "discontinuity": group, "init_path": init, "enc_method": use.get("method"), "key_uri": use.get("uri"), "iv": use.get("iv"),
            })
            now += duration
            unix = None if unix is None else unix + duration
            duration = None
            if piece is None:
                piece_end = None
            piece = None
            seq += 1
        elif tag == "#EXTINF":
            if not started and dated is None and seq > 0 and target is not None:
                now = seq * target
            started = True
            duration = _number(value.split(",", 1)[0], "#EXTINF")
        elif tag == "#EXT-X-MAP":
            a = attributes(value)
            if not a.get("uri"):
                raise PlaylistError("#EXT-X-MAP needs a URI")
            if "byterange" in a and _range(a["byterange"])[1] is None:
                raise PlaylistError("#EXT-X-MAP: a byte range needs an offset")
            if key and key["method"] == "AES-128" and key["iv"] is None:
                raise PlaylistError("#EXT-X-KEY before #EXT-X-MAP needs an IV")
            init = join_path(path, a["uri"])
        elif tag == "#EXT-X-KEY":
            a = attributes(value)
            method = a.get("method")
            if method == "NONE":
                key = None
            elif method in ("AES-128", "SAMPLE-AES", "SAMPLE-AES-CTR"):
                if not a.get("uri"):
                    raise PlaylistError(f"#EXT-X-KEY: {method} needs a URI")
                identity = a.get("keyformat", "identity") == "identity"
                if identity != (method == "AES-128"):
                    raise PlaylistError(f"#EXT-X-KEY: key format {a.get('keyformat', 'identity')} with {method}")
                iv = a.get("iv")
                if iv is not None and not re.fullmatch(r"0[xX][0-9a-fA-F]+", iv):
                    raise PlaylistError(f"IV {iv!r}")
                key = {"method": method, "uri": join_path(path, a["uri"]) if method == "AES-128" else a["uri"], "iv": iv[2:].lower().rjust(32, "0")[-32:] if iv else None}
            else:
                raise PlaylistError(f"encryption method {method!r}")
        elif tag == "#EXT-X-MEDIA-SEQUENCE":
            seq = _number(value, "#EXT-X-MEDIA-SEQUENCE", int)
        elif tag == "#EXT-X-BYTERANGE":
            length, offset = _range(value)
            if offset is None:
                if piece_end is None:
                    raise PlaylistError("#EXT-X-BYTERANGE without an offset needs a range before it")
                offset = piece_end
            piece, piece_end = (offset, length), offset + length
        elif tag == "#EXT-X-PROGRAM-DATE-TIME":
            date = _date(value)
            if date is None or date == dated:
                continue
            if dated is None and out:
                shift = date - (out[-1]["start"] + out[-1]["duration"])
                for s in out:
                    s["unix_start"] = s["start"] + shift
                    if offset_by_date:
                        s["start"] = s["unix_start"]
            dated = unix = date
            if offset_by_date:
                now = date
        elif line == "#EXT-X-DISCONTINUITY":
            group += 1
        elif tag == "#EXT-X-TARGETDURATION":
            target = _number(value, "#EXT-X-TARGETDURATION")
        elif line == "#EXT-X-ENDLIST":
            ended = True
            break
        elif tag == "#EXT-X-PLAYLIST-TYPE" and value.lower() == "vod":
            ended = True
    return [s | {"ended": ended, "target_duration": target} for s in out]


def parse_master_playlist(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Variants (path, bandwidth, codecs, resolution, frame rate, groups) and renditions (type, group, name, language, path, flags)."""
    variants, media = [], []
    waiting: dict | None = None
    for line in lines_of(text):
        tag, _, value = line.partition(":")
        if tag in ("#EXT-X-STREAM-INF", "#EXT-X-I-FRAME-STREAM-INF"):
            a = attributes(value)
            w, _, h = a.get("resolution", "").partition("x")
            row = {
                "variant": len(variants), "bandwidth": int(a["bandwidth"]) if a.get("bandwidth", "").isdigit() else None, "average_bandwidth": int(a["average-bandwidth"]) if a.get("average-bandwidth", "").isdigit() else None,
                "codecs": [c.strip() for c in a.get("codecs", "").split(",") if c.strip()], "width": int(w) if w.isdigit() else None, "height": int(h) if h.isdigit() else None, "frame_rate": float(a["frame-rate"]) if "frame-rate" in a else None,
                "audio": a.get("audio"), "video": a.get("video"), "subtitles": a.get("subtitles"), "only_key": tag == "#EXT-X-I-FRAME-STREAM-INF",
            }
            if row["only_key"]:
                if not a.get("uri"):
                    raise PlaylistError(f"{tag} needs a URI")
                variants.append(row | {"path": join_path(path, a["uri"])})
            else:
                waiting = row
        elif tag == "#EXT-X-MEDIA":
            a = attributes(value)
            flags = {}
            for name in ("default", "autoselect", "forced"):
                flag = a.get(name, "NO").upper()
                if flag not in ("YES", "NO"):
                    raise PlaylistError(f"{name}={flag}")
                flags[name] = flag == "YES"
            media.append({"type": a.get("type", "").lower(), "group_id": a.get("group-id"), "name": a.get("name"), "language": a.get("language"), "path": join_path(path, a["uri"]) if a.get("uri") else None, **flags})
        elif not line.startswith("#") and waiting is not None:
            variants.append(waiting | {"variant": len(variants), "path": join_path(path, line)})
            waiting = None
    return variants, media


def read_media_playlists(files: DataFrame, path: str = "path", text: str = "text", offset_by_date: bool = True) -> DataFrame:
    """One row per segment of each playlist file. A playlist that can't be read is an error, not a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse_media_playlist(p, t, offset_by_date)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(SEGMENT_COLUMNS))

    return files.select(path, text).mapInArrow(run, SEGMENT_SCHEMA)


def segment_at(segments: DataFrame, times: DataFrame) -> DataFrame:
    """The segment of each asked time (playlist, us): the last that starts at or before it."""
    from ..operators.packets import as_of

    base = segments.select("playlist", F.floor(F.col("start") * 1e6 + 0.5).cast("long").alias("us"), "seq_no", "path")
    return as_of(times, base, ["playlist"], ["seq_no", "path"])


def neighbours(segments: DataFrame) -> DataFrame:
    """Adds previous_seq and next_seq: the segments before and after each one in its playlist, null at the ends."""
    order = Window.partitionBy("playlist").orderBy("seq_no")
    return segments.withColumns({"previous_seq": F.lag("seq_no").over(order), "next_seq": F.lead("seq_no").over(order)})


#: Fixed value: seconds by which a segment's own times may be off before they are no longer trusted.
TRUSTED = 0.25


def adjust_packets(segments: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets of a playlist's segments on one clock: ``timestamp`` and ``seq`` are replaced.

    segments: playlist, seq_no, start, discontinuity; packets: playlist, seq_no,
    track_id, seq, timestamp, time_resolution. Segments between two breaks keep
    their own times, moved by what sets the first of them to its start; one whose
    times stray from the playlist is set to its own start instead. Sequence
    numbers leave room for the bytes of the time before, so that they rise from
    segment to segment.
    """
    first = packets.groupBy("playlist", "seq_no", "track_id").agg(F.min_by("timestamp", "seq").alias("t")).groupBy("playlist", "seq_no").agg(F.min("t").alias("own"))
    known = segments.select("playlist", "seq_no", "start", "discontinuity").join(first, ["playlist", "seq_no"])
    run = Window.partitionBy("playlist", "discontinuity").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("playlist").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumns({"start0": F.first("start").over(run), "own0": F.first("own").over(run), "begin": F.first("start").over(whole)})
    elapsed = F.col("start") - F.col("start0")
    stray = F.abs((F.col("own") - F.col("own0")) - elapsed)
    leads = (F.col("start") == F.col("start0")) & (F.col("own") == F.col("own0"))
    offset = F.when(leads | (stray <= F.least(F.lit(TRUSTED), elapsed)), F.col("start0") - F.col("own0")).otherwise(F.col("start") - F.col("own"))
    moved = known.select("playlist", "seq_no", offset.alias("_offset"), F.floor(F.lit(1e8) * (F.col("start") - F.col("begin"))).cast("long").alias("_before"))
    joined = packets.join(moved, ["playlist", "seq_no"])
    at = F.floor((F.col("timestamp") + F.col("_offset")) * F.col("time_resolution") + 0.5) / F.col("time_resolution")
    return joined.withColumns({"timestamp": at, "seq": F.col("_before") + F.col("seq")}).drop("_offset", "_before")


def media_playlist(segments: DataFrame, keys: Sequence[str], top: DataFrame, done: bool = True, version: int = 3) -> DataFrame:
    """One playlist text per key: segments have i, path and seconds (text); top has ``target``, whole seconds."""
    head = f"#EXTM3U\n#EXT-X-VERSION:{version}\n" + ("#EXT-X-PLAYLIST-TYPE:VOD\n" if done else "") + "#EXT-X-TARGETDURATION:"
    entry = F.concat(F.lit("#EXTINF:"), F.col("seconds"), F.lit(",\n"), F.col("path"), F.lit("\n"))
    body = segments.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))), lambda x: x["e"]), "").alias("_body"))
    text = F.concat(F.lit(head), F.col("target").cast("string"), F.lit("\n#EXT-X-INDEPENDENT-SEGMENTS\n\n"), F.col("_body"), F.lit("\n#EXT-X-ENDLIST\n" if done else ""))
    return body.join(top, list(keys)).select(*keys, text.alias("playlist"))


def decrypt_segments(segments: DataFrame, data: str, key: str) -> DataFrame:
    """Adds ``clear``: AES-128-CBC data with its hex ``iv`` and binary key, decrypted by Spark's own function."""
    whole = F.concat(F.unhex("iv"), F.col(data))
    return segments.withColumn("clear", F.when(F.col("enc_method").isNull(), F.col(data)).otherwise(F.aes_decrypt(whole, F.col(key), F.lit("CBC"), F.lit("PKCS"))))

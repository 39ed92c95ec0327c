"""Media files as tables: detection, tracks, packets, tags.

Files come from Spark's binaryFile source, so they are listed, filtered and
split over tasks by Spark, in any store that it reads. One file is parsed in
one task; ``packets(data=False)`` keeps payloads out of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac_file, isobmff, matroska, mpeg_audio, mpegts, ogg_file, wave_file
from .model import Media, MediaError
from .tags import normalised

#: Order of detection: what can be told from a few bytes first.
FORMATS: list[tuple[str, Callable[[bytes], bool], Callable[[bytes], Media]]] = [
    ("isobmff", isobmff.is_isobmff, isobmff.parse),
    ("matroska", matroska.is_matroska, matroska.parse),
    ("wave", wave_file.is_wave, wave_file.parse),
    ("ogg", ogg_file.is_ogg, ogg_file.parse),
    ("flac", flac_file.is_flac, flac_file.parse),
    ("mpegts", mpegts.is_mpegts, mpegts.parse),
    ("mp3", mpeg_audio.is_mp3, mpeg_audio.parse_mp3),
    ("adts", mpeg_audio.is_adts, mpeg_audio.parse_adts),
]

TRACK_SCHEMA = "file_id string, format string, track_id int, number int, type string, codec string, codec_string string, internal_codec_id string, language string, name string, time_resolution double, duration_meta double, bitrate double, only_key boolean, is_default boolean, decoder_description binary, coded_width int, coded_height int, rotation int, channels int, sample_rate int, ordinal int"
PACKET_SCHEMA = "file_id string, track_id int, seq long, type string, pts_ticks long, timestamp double, duration double, byte_offset long, byte_length int, data binary"
TAG_SCHEMA = "file_id string, format string, title string, description string, artist string, album string, album_artist string, genre string, lyrics string, comment string, track_no int, tracks_total int, disc_no int, discs_total int, date string, raw map<string,string>"
#: Bytes of rows that are sent on at once, and what a row counts besides its data.
BATCH_BYTES, ROW_BYTES = 4_000_000, 400
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", ")])


def detect(data: bytes) -> str | None:
    """The container family of these bytes, or None."""
    return next((name for name, test, _ in FORMATS if test(data)), None)


def parse(data: bytes) -> Media:
    for _, test, read in FORMATS:
        if test(data):
            return read(data)
    raise MediaError("unknown format")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_id, path, length, modified, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.select(F.col("path").alias("file_id"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def _read(rows: DataFrame, schema: str, emit: Callable[[str, bytes, Media], Iterator[dict]], errors: str) -> DataFrame:
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of several files go out as one batch, as small files would cost a batch each.
        held, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    media = parse(data)
                except (MediaError, IndexError, ValueError) as e:
                    if errors == "raise":
                        raise MediaError(f"{name}: {e}") from e
                    continue
                for row in emit(name.as_py(), data, media):
                    held.append(row)
                    size += len(row.get("data") or row.get("_inline") or b"") + ROW_BYTES
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
            batch = name = content = data = media = None  # the next batch comes before a name is given anew
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return rows.select("file_id", "content").mapInArrow(run, schema)


def formats(rows: DataFrame) -> DataFrame:
    """file_id, format: the family of each file told from its bytes, null if it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([detect(c.as_py() or b"") for c in batch.column(1)], pa.string())], names=["file_id", "format"])

    return rows.select("file_id", "content").mapInArrow(run, "file_id string, format string")


def track_rows(name: str, data: bytes, media: Media) -> Iterator[dict]:
    numbers: dict[str, int] = {}
    for i, t in enumerate(media.tracks):
        numbers[t.type] = numbers.get(t.type, 0) + 1
        span = max((p.ticks + p.duration_ticks for p in t.packets), default=0) - min((p.ticks for p in t.packets), default=0)
        yield {
            "file_id": name, "format": media.format, "track_id": t.track_id, "number": numbers[t.type], "type": t.type, "codec": t.codec, "codec_string": t.codec_string, "internal_codec_id": t.internal_codec_id, "language": t.language, "name": t.name,
            "time_resolution": t.resolution, "duration_meta": t.duration_ticks / t.resolution if t.duration_ticks else None, "bitrate": 8 * sum(p.length for p in t.packets) * t.resolution / span if span else None, "only_key": all(p.key for p in t.packets),
            "is_default": t.default, "decoder_description": t.description, "coded_width": t.width, "coded_height": t.height, "rotation": t.rotation, "channels": t.channels, "sample_rate": t.sample_rate, "ordinal": i,
        }


def packet_rows(name: str, content: bytes, media: Media, data: bool) -> Iterator[dict]:
    for t in media.tracks:
        for p in t.packets:
            row = {"file_id": name, "track_id": t.track_id, "seq": p.seq, "type": "key" if p.key else "delta", "pts_ticks": p.ticks, "timestamp": p.ticks / t.resolution, "duration": p.duration_ticks / t.resolution, "byte_offset": p.offset, "byte_length": p.length, "data": None}
            if data:
                row["data"] = p.data if p.data is not None else content[p.offset : p.offset + p.length]
            elif p.data is not None:
                row["_inline"] = p.data
            yield row


def tag_rows(name: str, data: bytes, media: Media) -> Iterator[dict]:
    numbers = ("track_no", "tracks_total", "disc_no", "discs_total")
    found = normalised(media.tags)
    row = {k: int(v) if k in numbers and str(v).isdigit() else v for k, v in found.items()}
    yield {"file_id": name, "format": media.format, **{f.split()[0]: row.get(f.split()[0]) for f in TAG_SCHEMA.split(", ")[2:-1]}, "raw": list(media.tags.items())}


def tracks(rows: DataFrame, errors: str = "raise") -> DataFrame:
    """One row per track of each file. errors: "raise", or "skip" files that can't be read."""
    return _read(rows, TRACK_SCHEMA, track_rows, errors)


def packets(rows: DataFrame, data: bool = True, errors: str = "raise", types: Sequence[str] | None = None) -> DataFrame:
    """One row per packet, in decode order by ``seq``. data=False leaves payloads out; types are those of the tracks that are read (None: all)."""

    def emit(name: str, content: bytes, media: Media) -> Iterator[dict]:
        asked = media if types is None else replace(media, tracks=[t for t in media.tracks if t.type in types])
        return packet_rows(name, content, asked, data)

    return _read(rows, PACKET_SCHEMA, emit, errors)


def tags(rows: DataFrame, errors: str = "raise") -> DataFrame:
    """One row of metadata per file."""
    return _read(rows, TAG_SCHEMA, tag_rows, errors)


def as_packet_table(rows: DataFrame) -> DataFrame:
    """Packets with the columns that the operators use: us, dur, bytes, key."""
    micros = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    return rows.withColumns({"us": micros(F.col("timestamp")), "dur": micros(F.col("duration")), "bytes": F.col("byte_length").cast("long"), "key": F.col("type") == "key"})

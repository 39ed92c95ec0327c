"""MP4 and MOV files read by range: boxes and tables first, payloads only where they are asked for.

Spark lists the files without their contents. Each task opens its files in the
store and reads blocks as the parser asks for them, so a file of any size costs
its tables, a few block reads for the boxes between them, and the packets wanted.
Other formats are read whole.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import isobmff, media
from .model import Media, MediaError

BLOCK, KEPT = 1 << 16, 64


class Ranged:
    """A file as bytes that are read when they are asked for; keeps the last KEPT blocks."""

    def __init__(self, handle, size: int, block: int = BLOCK, kept: int = KEPT):
        self.handle, self.size, self.block, self.kept = handle, size, block, kept
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.read_bytes = 0

    def __len__(self) -> int:
        return self.size

    def _read(self, start: int, end: int) -> bytes:
        self.handle.seek(start)
        data = self.handle.read(end - start)
        self.read_bytes += len(data)
        return data

    def _block(self, k: int) -> bytes:
        if k in self.blocks:
            self.blocks.move_to_end(k)
        else:
            self.blocks[k] = self._read(k * self.block, min(self.size, (k + 1) * self.block))
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
        return self.blocks[k]

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            at += self.size if at < 0 else 0
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self._block(at // self.block)[at % self.block]
        start, end, step = at.indices(self.size)
        if step != 1:
            raise ValueError("only stretches")
        if end <= start:
            return b""
        if end - start > 4 * self.block:
            return self._read(start, end)  # large stretches pass by the blocks
        first, last = start // self.block, (end - 1) // self.block
        whole = b"".join(self._block(k) for k in range(first, last + 1))
        return whole[start - first * self.block : end - first * self.block]


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_id, length of the files; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.select(F.col("path").alias("file_id"), "length")


def opened(path: str) -> Ranged:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    handle = store.open_input_file(name)
    return Ranged(handle, handle.size())


def _parsed(data: Ranged) -> tuple[Media, bytes | Ranged]:
    head = data[:12]
    if isobmff.is_isobmff(head):
        return isobmff.parse(data), data
    whole = data[0 : len(data)]
    return media.parse(whole), whole


def _rows(files: DataFrame, schema: str, emit, errors: str) -> DataFrame:
    kinds = media._arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    found, data = _parsed(opened(name))
                except (MediaError, IndexError, ValueError) as e:
                    if errors == "raise":
                        raise MediaError(f"{name}: {e}") from e
                    continue
                held, size = [], 0
                for row in emit(name, data, found):
                    held.append(row)
                    size += len(row.get("data") or b"") + 100
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    return files.select("file_id").mapInArrow(run, schema)


def tracks(files: DataFrame, errors: str = "raise") -> DataFrame:
    """What media.tracks gives, for a listing."""
    return _rows(files, media.TRACK_SCHEMA, media.track_rows, errors)


def packets(files: DataFrame, data: bool = False, start: float | None = None, end: float | None = None, errors: str = "raise") -> DataFrame:
    """What media.packets gives, for a listing; payloads are read only with data=True, and only of packets from start up to end."""

    def emit(name: str, content, found: Media) -> Iterator[dict]:
        for row in media.packet_rows(name, content, found, False):
            if (start is None or row["timestamp"] >= start) and (end is None or row["timestamp"] < end):
                if data:
                    row["data"] = row.pop("_inline", None) or content[row["byte_offset"] : row["byte_offset"] + row["byte_length"]]
                yield row

    return _rows(files, media.PACKET_SCHEMA, emit, errors)


def tags(files: DataFrame, errors: str = "raise") -> DataFrame:
    """What media.tags gives, for a listing."""
    return _rows(files, media.TAG_SCHEMA, media.tag_rows, errors)

"""Streaming: live playlists as a source, windows over packets, segments as they fill, progressive playlists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.hls import SEGMENT_COLUMNS, SEGMENT_SCHEMA, parse_media_playlist


class LivePlaylist(DataSource):
    """``spark.readStream.format("live_playlist").option("path", ...)``: the segments of a playlist that is read again and again.

    The offset is the next media sequence number, so a segment is read once,
    in order, however often the playlist shows it. Options: ``store``, a folder
    where what was read is written before it is handed on, so that a batch can be
    read again after its segments have left the playlist (without it such a batch
    is an error, never a silent loss); ``max_segments``, how many a batch takes.
    """

    @classmethod
    def name(cls) -> str:
        return "live_playlist"

    def schema(self) -> str:
        return SEGMENT_SCHEMA

    def simpleStreamReader(self, schema):  # noqa: N802, ANN001, ANN201
        return _PlaylistReader(self.options)


class _PlaylistReader(SimpleDataSourceStreamReader):
    def __init__(self, options):  # noqa: ANN001
        self.path, self.by_date = options["path"], options.get("offset_by_date", "true") != "false"
        self.store, self.most = options.get("store"), int(options.get("max_segments", "0"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def _segments(self) -> list[dict]:
        from urllib.request import urlopen

        local = "://" not in self.path
        with open(self.path, encoding="utf-8") if local else urlopen(self.path) as f:  # noqa: S310
            text = f.read()
        return parse_media_playlist(self.path, text if local else text.decode(), self.by_date)

    def _folder(self):  # noqa: ANN202
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.store) if ":" in self.store.split("/", 1)[0] else (fs.LocalFileSystem(), self.store)
        store.create_dir(base, recursive=True)
        return store, base

    def _keep(self, rows: list[dict]) -> None:
        """Writes segments, a file each, by a rename; one that is there stays."""
        import json

        store, base = self._folder()
        for s in rows:
            name = f"{base}/{s['seq_no']:020d}.json"
            if store.get_file_info(name).type.name == "NotFound":
                with store.open_output_stream(f"{name}.part") as out:
                    out.write(json.dumps(s).encode())
                store.move(f"{name}.part", name)

    def _kept(self, start: int, end: int) -> dict[int, dict]:
        import json

        store, base = self._folder()
        out = {}
        for n in range(start, end):
            name = f"{base}/{n:020d}.json"
            if store.get_file_info(name).type.name == "File":
                with store.open_input_stream(name) as f:
                    out[n] = json.loads(f.read())
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [s for s in self._segments() if s["seq_no"] >= start["next"]]
        rows = rows[: self.most] if self.most > 0 else rows
        if self.store:
            self._keep(rows)
        end = {"next": rows[-1]["seq_no"] + 1} if rows else start
        return iter([tuple(s[n] for n, _ in SEGMENT_COLUMNS) for s in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = self._kept(start["next"], end["next"]) if self.store else {}
        if len(rows) < end["next"] - start["next"]:
            rows = {s["seq_no"]: s for s in self._segments() if start["next"] <= s["seq_no"] < end["next"]} | rows
        # Numbers have no gaps, but for those before the first one that was ever seen.
        first = min(rows, default=None)
        if end["next"] > start["next"] and (first is None or len(rows) < end["next"] - first or start["next"] > 0 and first > start["next"]):
            raise ValueError(f"segments {start['next']} to {end['next'] - 1} have left {self.path}; name a store to read them again")
        return iter([tuple(rows[k][n] for n, _ in SEGMENT_COLUMNS) for k in sorted(rows)])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LivePlaylist)


def windowed_stats(packets: DataFrame, keys: list[str], width: str = "10 seconds", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Packets, bytes and key packets per window of event time ``ts``.

    Without ``late`` no row is ever dropped, and windows are revised when late
    rows come (output mode update or complete). With it, windows are final that
    much after the newest row, and Spark drops what comes later still.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = packets.withWatermark("ts", late) if late else packets
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.sum(F.col("key").cast("long")).alias("keys")).select("w.start", "w.end", *keys, "packets", "bytes", "keys")


REORDERED = "track long, seq long, us long, bytes long, key boolean, place long"


def reorder(packets: DataFrame, depth: int = 16) -> DataFrame:
    """Packets of each track in presentation order, held back until ``depth`` others are there; ``place`` counts them.

    State is at most depth packets of a track. A packet that comes after a later
    one has been sent is an error: the depth was too small.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, last, held = state.get if state.exists else (0, None, [])
        held = [tuple(h) for h in held]
        out = []
        for seq, us, size, is_key in pd.concat(list(batches)).sort_values("seq")[["seq", "us", "bytes", "key"]].itertuples(index=False):
            if last is not None and us < last:
                raise ValueError(f"track {key[0]}: packet {seq} came more than {depth} packets late")
            held.append((int(us), int(seq), int(size), bool(is_key)))
            held.sort()
            while len(held) > depth:
                u, s, b, k = held.pop(0)
                out.append((key[0], s, u, b, k, place))
                place, last = place + 1, u
        state.update((place, last, held))
        yield pd.DataFrame(out, columns=["track", "seq", "us", "bytes", "key", "place"])

    return packets.groupBy("track").applyInPandasWithState(step, REORDERED, "place long, last long, held array<struct<us: long, seq: long, bytes: long, key: boolean>>", "append", GroupStateTimeout.NoTimeout)


SEGMENT_OUT = "track long, segment long, start_us long, end_us long, packets long, bytes long"


def segment_stream(packets: DataFrame, target_us: int = 2_000_000) -> DataFrame:
    """Segments of each track as they are complete. Input: track, seq, us, bytes, key; output SEGMENT_OUT.

    A segment is cut at a key packet: at the last one that starts within the
    target, else the first one after. State is the open segment's groups of
    pictures as sums, so it stays small however long the stream is. Packets
    of a track must arrive in decode order between micro-batches; an earlier
    one that arrives late is an error, never dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, last, groups = state.get if state.exists else (0, -1, [])
        groups = [list(g) for g in groups]
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, us, size, is_key in rows[["seq", "us", "bytes", "key"]].itertuples(index=False):
            if seq <= last:
                raise ValueError(f"track {key[0]}: packet {seq} came after {last}")
            last = int(seq)
            if is_key or not groups:
                # A group: its start, packets, bytes. Once the newest one begins beyond the target, all before the last that fits go.
                while groups and us - groups[0][0] > target_us:
                    inside = [i for i, g in enumerate(groups) if i and g[0] - groups[0][0] <= target_us]
                    cut = inside[-1] if inside else len(groups)
                    done, groups = groups[:cut], groups[cut:]
                    out.append((key[0], segment, done[0][0], groups[0][0] if groups else int(us), sum(g[1] for g in done), sum(g[2] for g in done)))
                    segment += 1
                groups.append([int(us), 0, 0])
            groups[-1][1] += 1
            groups[-1][2] += int(size)
        state.update((segment, last, [tuple(g) for g in groups]))
        yield pd.DataFrame(out, columns=["track", "segment", "start_us", "end_us", "packets", "bytes"])

    return packets.groupBy("track").applyInPandasWithState(step, SEGMENT_OUT, "segment long, last long, groups array<struct<us: long, n: long, bytes: long>>", "append", GroupStateTimeout.NoTimeout)


def live_window(segments: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The last ``most`` segments of each track: what a live playlist keeps. Segments are numbered without gaps."""
    newest = segments.groupBy(*keys).agg(F.max("segment").alias("_newest"))
    return segments.join(newest, keys).filter(F.col("segment") > F.col("_newest") - most).drop("_newest")


def write_progressively(segments: DataFrame, path: str, checkpoint: str):
    """Starts a query that, after each micro-batch, adds the batch's segments under ``path`` and is idempotent by batch id."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return segments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()

"""Decoders and encoders as plug-ins: a registry by codec, applied to packets, samples and frames of a track in order.

PCM is built in. Other codecs are registered as plain functions; what has been
registered answers which codecs can be decoded and encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.conversion import AUDIO_CODECS, SUBTITLE_CODECS, VIDEO_CODECS
from . import pixels
from .audio import alaw_decode, alaw_encode, ulaw_decode, ulaw_encode

#: payload, channels -> frames as float samples, interleaved.
Decoder = Callable[[bytes, int], np.ndarray]
#: float samples, interleaved, channels -> payload.
Encoder = Callable[[np.ndarray, int], bytes]
#: A track's state, which the function may change, and a packet's payload -> a frame as RGBA in 0 to 1, or None if none is ready.
VideoDecoder = Callable[[dict, bytes], "np.ndarray | None"]
#: A track's state, a frame as RGBA, whether it must be a key frame -> payload and whether it is one.
VideoEncoder = Callable[[dict, np.ndarray, bool], "tuple[bytes, bool]"]


def pcm(codec: str) -> Decoder:
    """The built-in decoder of a PCM codec."""
    if codec in ("ulaw", "alaw"):
        f = ulaw_decode if codec == "ulaw" else alaw_decode
        return lambda data, channels: f(np.frombuffer(data, np.uint8)) / 32768.0
    body = codec.removeprefix("pcm-")
    order, kind, bits = (">" if body.endswith("be") else "<"), body[0], int(body[1:].removesuffix("be"))
    if bits == 24:

        def decode(data: bytes, channels: int) -> np.ndarray:
            raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
            a, b, c = (raw[:, 0], raw[:, 1], raw[:, 2]) if order == ">" else (raw[:, 2], raw[:, 1], raw[:, 0])
            return ((a << 24) | (b << 16) | (c << 8)) / 2147483648.0

        return decode
    if kind == "f":
        return lambda data, channels: np.frombuffer(data, f"{order}f{bits // 8}").astype(float)
    if kind == "u":
        return lambda data, channels: (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    return lambda data, channels: np.frombuffer(data, f"{order}i{bits // 8}") / float(1 << (bits - 1))


def pcm_encoder(codec: str) -> Encoder:
    """The built-in encoder of a PCM codec: samples in [-1, 1] are clamped."""
    if codec in ("ulaw", "alaw"):
        f = ulaw_encode if codec == "ulaw" else alaw_encode
        return lambda x, channels: f(np.clip(np.floor(x * 32767 + 0.5), -32768, 32767).astype(np.int64)).astype(np.uint8).tobytes()
    body = codec.removeprefix("pcm-")
    order, kind, bits = (">" if body.endswith("be") else "<"), body[0], int(body[1:].removesuffix("be"))
    if kind == "f":
        return lambda x, channels: x.astype(f"{order}f{bits // 8}").tobytes()
    if kind == "u":
        return lambda x, channels: np.clip(np.floor((x + 1) * 127.5), 0, 255).astype(np.uint8).tobytes()

    def encode(x: np.ndarray, channels: int) -> bytes:
        top = (1 << (bits - 1)) - 1
        whole = np.clip(np.floor(x.astype(np.float64) * top + 0.5), -top - 1, top).astype(np.int64)
        if bits != 24:
            return whole.astype(f"{order}i{bits // 8}").tobytes()
        raw = whole.astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:]
        return (raw if order == ">" else raw[:, ::-1]).tobytes()

    return encode


PCM = ("pcm-u8", "pcm-s8", *(f"pcm-{k}{e}" for k in ("s16", "s24", "s32", "f32", "f64") for e in ("", "be")), "ulaw", "alaw")


@dataclass
class Registry:
    """Decoders and encoders by codec, and transformers of frames by name; the PCM ones are there from the start."""

    decoders: dict[str, Decoder] = field(default_factory=lambda: {c: pcm(c) for c in PCM})
    encoders: dict[str, Encoder] = field(default_factory=lambda: {c: pcm_encoder(c) for c in PCM})
    video_decoders: dict[str, VideoDecoder] = field(default_factory=dict)
    video_encoders: dict[str, VideoEncoder] = field(default_factory=dict)
    transformers: dict[str, Callable[[np.ndarray], np.ndarray]] = field(default_factory=dict)

    def register(self, codec: str, decoder: Decoder | VideoDecoder) -> None:
        """Adds a decoder; of what kind, the codec tells."""
        (self.video_decoders if codec in VIDEO_CODECS else self.decoders)[codec] = decoder

    def register_encoder(self, codec: str, encoder: Encoder | VideoEncoder) -> None:
        (self.video_encoders if codec in VIDEO_CODECS else self.encoders)[codec] = encoder

    def register_transformer(self, name: str, transformer: Callable[[np.ndarray], np.ndarray]) -> None:
        """Adds a function of RGBA frames, as ``transform_video`` applies it."""
        self.transformers[name] = transformer

    def can_decode(self, codec: str) -> bool:
        return codec in self.decoders or codec in self.video_decoders

    def can_decode_video(self, codec: str) -> bool:
        return codec in self.video_decoders

    def can_decode_audio(self, codec: str) -> bool:
        return codec in self.decoders

    def can_encode(self, codec: str) -> bool:
        return codec in self.encoders or codec in self.video_encoders or codec in SUBTITLE_CODECS

    def can_encode_video(self, codec: str, width: int = 1280, height: int = 720, bitrate: int = 1_000_000) -> bool:
        """Whether there is an encoder, and the sizes are ones that a frame can have."""
        return codec in self.video_encoders and width > 0 and height > 0 and bitrate > 0

    def can_encode_audio(self, codec: str, channels: int = 2, sample_rate: int = 48_000, bitrate: int = 128_000) -> bool:
        return codec in self.encoders and channels > 0 and sample_rate > 0 and bitrate > 0

    def can_encode_subtitles(self, codec: str) -> bool:
        return codec in SUBTITLE_CODECS

    def decodable(self) -> list[str]:
        return sorted({*self.decoders, *self.video_decoders})

    def decodable_video(self) -> list[str]:
        return sorted(self.video_decoders)

    def decodable_audio(self) -> list[str]:
        return sorted(self.decoders)

    def encodable(self) -> list[str]:
        return sorted({*self.encoders, *self.video_encoders, *SUBTITLE_CODECS})

    def encodable_video(self) -> list[str]:
        """In the order of preference of the codec list."""
        return [c for c in VIDEO_CODECS if c in self.video_encoders]

    def encodable_audio(self) -> list[str]:
        return [c for c in (*AUDIO_CODECS, *PCM) if c in self.encoders]

    def encodable_subtitles(self) -> list[str]:
        return list(SUBTITLE_CODECS)

    def first_encodable(self, codecs: list[str]) -> str | None:
        """The first of these codecs that can be encoded, or None."""
        return next((c for c in codecs if self.can_encode(c)), None)


def decode_audio(packets: DataFrame, registry: Registry) -> DataFrame:
    """file_id, track_id, seq, timestamp, channels, sample_rate, frames, samples of every packet.

    Packets need codec, channels, sample_rate and data. A packet without data,
    or that holds no whole frame, is dropped; an unknown codec is an error.
    """
    decoders = registry.decoders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["codec"] not in decoders:
                    raise ValueError(f"no decoder for {r['codec']}")
                samples = decoders[r["codec"]](r["data"], r["channels"]) if r["data"] else np.zeros(0)
                frames = len(samples) // r["channels"]
                if frames:
                    rows.append({**{k: r[k] for k in ("file_id", "track_id", "seq", "timestamp", "channels", "sample_rate")}, "frames": frames, "samples": samples[: frames * r["channels"]].astype(np.float32)})
            if rows:
                kinds = pa.schema([("file_id", pa.string()), ("track_id", pa.int32()), ("seq", pa.int64()), ("timestamp", pa.float64()), ("channels", pa.int32()), ("sample_rate", pa.int32()), ("frames", pa.int32()), ("samples", pa.list_(pa.float32()))])
                yield pa.RecordBatch.from_pylist(rows, kinds)

    wanted = packets.select("file_id", "track_id", "seq", "timestamp", "codec", "channels", "sample_rate", "data")
    return wanted.mapInArrow(run, "file_id string, track_id int, seq long, timestamp double, channels int, sample_rate int, frames int, samples array<float>")


def encode_audio(samples: DataFrame, registry: Registry, codec: str) -> DataFrame:
    """file_id, track_id, seq, type, timestamp, duration, data: each row of samples (as decode_audio gives them) as a packet."""
    if not registry.can_encode_audio(codec):
        raise ValueError(f"no encoder for {codec}")
    encode = registry.encoders[codec]
    kinds = pa.schema([("file_id", pa.string()), ("track_id", pa.int32()), ("seq", pa.int64()), ("type", pa.string()), ("timestamp", pa.float64()), ("duration", pa.float64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.asarray(r["samples"] or [], float)
                rows.append({**{k: r[k] for k in ("file_id", "track_id", "seq", "timestamp")}, "type": "key", "duration": len(x) // r["channels"] / r["sample_rate"], "data": encode(x, r["channels"])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    wanted = samples.select("file_id", "track_id", "seq", "timestamp", "channels", "sample_rate", "samples")
    return wanted.mapInArrow(run, "file_id string, track_id int, seq long, type string, timestamp double, duration double, data binary")


def _by_track(rows: DataFrame, step, schema: str, kinds: pa.Schema) -> DataFrame:
    """Rows of a track in decode order through a function with state; a track is a stream in one task and is never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if (r["file_id"], r["track_id"]) != now:
                    now, state = (r["file_id"], r["track_id"]), {}
                out = step(state, r)
                if out is not None:
                    yield pa.RecordBatch.from_pylist([out], kinds)

    return rows.repartition("file_id", "track_id").sortWithinPartitions("file_id", "track_id", "seq").mapInArrow(run, schema)


_FRAME = pa.schema([("file_id", pa.string()), ("track_id", pa.int32()), ("seq", pa.int64()), ("timestamp", pa.float64()), ("duration", pa.float64()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rotation", pa.int32()), ("data", pa.binary())])
_PACKET = pa.schema([("file_id", pa.string()), ("track_id", pa.int32()), ("seq", pa.int64()), ("type", pa.string()), ("timestamp", pa.float64()), ("duration", pa.float64()), ("data", pa.binary())])


def decode_video(packets: DataFrame, registry: Registry, codec: str) -> DataFrame:
    """Packets of tracks of one codec as RGBA frames (pixels.FRAMES); a decoder's state runs from a track's first packet on."""
    if not registry.can_decode_video(codec):
        raise ValueError(f"no decoder for {codec}")
    decode = registry.video_decoders[codec]

    def step(state: dict, r: dict) -> dict | None:
        image = decode(state, r["data"] or b"")
        if image is None:
            return None
        return {**{k: r[k] for k in ("file_id", "track_id", "seq", "timestamp", "duration")}, "format": "RGBA", "width": image.shape[1], "height": image.shape[0], "rotation": 0, "data": pixels.from_rgba(image, "RGBA")}

    return _by_track(packets.select("file_id", "track_id", "seq", "timestamp", "duration", "data"), step, pixels.FRAMES, _FRAME)


def encode_video(frames: DataFrame, registry: Registry, codec: str, key_interval: float = 2.0) -> DataFrame:
    """Frames as packets; a key frame is asked for at the start and once in every interval of seconds."""
    if not registry.can_encode_video(codec):
        raise ValueError(f"no encoder for {codec}")
    encode = registry.video_encoders[codec]

    def step(state: dict, r: dict) -> dict:
        cell = None if key_interval <= 0 else int(r["timestamp"] // key_interval)
        data, key = encode(state, pixels.to_rgba(r["data"], r["format"], r["width"], r["height"]), key_interval <= 0 or state.get("cell") != cell)
        state["cell"] = cell
        return {**{k: r[k] for k in ("file_id", "track_id", "seq", "timestamp", "duration")}, "type": "key" if key else "delta", "data": data}

    return _by_track(frames.select(*[x.split()[0] for x in pixels.FRAMES.split(", ")]), step, "file_id string, track_id int, seq long, type string, timestamp double, duration double, data binary", _PACKET)


def transform_video(frames: DataFrame, registry: Registry, name: str) -> DataFrame:
    """Frames after a registered transformer."""
    change = registry.transformers[name]

    def step(state: dict, r: dict) -> dict:
        image = change(pixels.to_rgba(r["data"], r["format"], r["width"], r["height"]))
        return {**r, "width": image.shape[1], "height": image.shape[0], "data": pixels.from_rgba(image, r["format"])}

    return _by_track(frames.select(*[x.split()[0] for x in pixels.FRAMES.split(", ")]), step, pixels.FRAMES, _FRAME)

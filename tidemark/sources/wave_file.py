"""RIFF wave files: read and written."""

from __future__ import annotations

import struct

from .model import Media, MediaError, Packet, Track
from .tags import RIFF, id3v2

#: Frames of one packet.
FRAMES = 2048


def is_wave(data: bytes) -> bool:
    return data[:4] in (b"RIFF", b"RIFX", b"RF64") and data[8:12] == b"WAVE"


def _codec(kind: int, bits: int, little: bool) -> str | None:
    if kind == 6:
        return "alaw"
    if kind == 7:
        return "ulaw"
    if kind == 3 and bits in (32, 64):
        return f"pcm-f{bits}" + ("" if little else "be")
    if kind == 1 and bits == 8:
        return "pcm-u8"
    if kind == 1 and bits in (16, 24, 32):
        return f"pcm-s{bits}" + ("" if little else "be")
    return None


def parse(data: bytes) -> Media:
    if not is_wave(data):
        raise MediaError("not a wave file")
    little = data[:4] != b"RIFX"
    order = "<" if little else ">"
    at, track, tags, big = 12, None, {}, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(f"{order}I", data, at + 4)[0]
        body = at + 8
        if name == b"ds64":
            big = struct.unpack_from("<Q", data, body + 8)[0]
        elif name == b"fmt ":
            kind, channels, rate, _, block, bits = struct.unpack_from(f"{order}HHIIHH", data, body)
            if kind == 0xFFFE and size >= 40:
                (kind,) = struct.unpack_from(f"{order}H", data, body + 24)
            track = Track(1, "audio", _codec(kind, bits, little), float(rate), channels=channels, sample_rate=rate, internal_codec_id=str(kind))
        elif name == b"data":
            if track is None:
                raise MediaError("data before its format")
            size = big if data[:4] == b"RF64" and size == 0xFFFFFFFF and big is not None else size
            size = min(size, len(data) - body)
            frames = size // block if block else 0
            for i in range(-(-frames // FRAMES)):
                n = min(FRAMES, frames - i * FRAMES)
                track.packets.append(Packet(i, i * FRAMES, n, body + i * FRAMES * block, n * block))
            track.duration_ticks = frames
        elif name == b"LIST" and data[body : body + 4] == b"INFO":
            p = body + 4
            while p + 8 <= min(body + size, len(data)):
                key, n = data[p : p + 4].decode("latin-1"), struct.unpack_from(f"{order}I", data, p + 4)[0]
                text = data[p + 8 : p + 8 + n].split(b"\0")[0].decode("utf-8", "replace").strip()
                if key in RIFF and text:
                    tags.setdefault(RIFF[key], text)
                p += 8 + n + (n & 1)
        elif name in (b"id3 ", b"ID3 "):
            tags = {**id3v2(data[body : body + size]), **tags}
        at = body + size + (size & 1)
    if track is None:
        raise MediaError("no format chunk")
    return Media("wav", [track], tags)


def build(codec: str, channels: int, rate: int, samples: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A wave file around encoded samples."""
    kind = {"alaw": 6, "ulaw": 7}.get(codec) or (3 if codec.startswith("pcm-f") else 1)
    bits = 8 if codec in ("alaw", "ulaw") else int(codec.removeprefix("pcm-")[1:])
    block = channels * bits // 8
    chunks = [(b"fmt ", struct.pack("<HHIIHH", kind, channels, rate, rate * block, block, bits))]
    if tags:
        names = {}
        for name, key in RIFF.items():
            names.setdefault(key, name)
        info = b"INFO"
        for key, value in tags.items():
            if key in names:
                text = value.encode() + b"\0"
                info += names[key].encode() + struct.pack("<I", len(text)) + text + b"\0" * (len(text) & 1)
        chunks.append((b"LIST", info))
    chunks.append((b"data", samples))
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body

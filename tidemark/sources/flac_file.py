"""FLAC streams."""

from __future__ import annotations

import struct

from .checksums import crc8, crc16
from .model import Media, MediaError, Packet, Track
from .tags import vorbis_comments

#: Sampling rates and block sizes that a frame header names.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}


def is_flac(data: bytes) -> bool:
    return data[:4] == b"fLaC"


def frame_header(data: bytes, at: int) -> dict | None:
    """Block size and header length of the frame at this place, or None; its checksum must fit."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    if not size_code or rate_code == 15 or data[at + 3] & 1:
        return None
    lead, p = data[at + 4], at + 5
    if lead >= 0x80:  # the frame's number, coded as UTF-8 codes characters
        extra = next((i for i in range(1, 7) if not lead & (0x40 >> (i - 1))), 0)
        if lead < 0xC0 or not extra:
            return None
        p += extra
    if size_code == 1:
        block = 192
    elif size_code <= 5:
        block = 576 << (size_code - 2)
    elif size_code == 6:
        block, p = data[p] + 1 if p < len(data) else 0, p + 1
    elif size_code == 7:
        block, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        block = 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return {"block": block, "head": p + 1 - at}


def parse(data: bytes) -> Media:
    if not is_flac(data):
        raise MediaError("not a FLAC stream")
    at, last, track, tags = 4, False, None, {}
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            rate, channels, total = word >> 44, ((word >> 41) & 7) + 1, word & ((1 << 36) - 1)
            track = Track(1, "audio", "flac", float(rate), channels=channels, sample_rate=rate, codec_string="flac", description=data[: at + 4 + size], duration_ticks=total or None)
        elif kind == 4:
            tags = vorbis_comments(body)
        at += 4 + size
    if track is None:
        raise MediaError("no stream information")
    ticks = 0
    while at < len(data) and (h := frame_header(data, at)):
        # A frame ends where the next header fits and the checksum of all before it does.
        end = at + h["head"]
        while True:
            end = data.find(b"\xff", end)
            if end < 0:
                end = len(data)
                break
            if frame_header(data, end) and crc16(data[at : end - 2]) == struct.unpack(">H", data[end - 2 : end])[0]:
                break
            end += 1
        track.packets.append(Packet(len(track.packets), ticks, h["block"], at, end - at))
        ticks += h["block"]
        at = end
    track.duration_ticks = track.duration_ticks or ticks
    return Media("flac", [track], tags)

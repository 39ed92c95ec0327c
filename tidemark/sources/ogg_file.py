"""Ogg streams of Opus and Vorbis, read and written."""

from __future__ import annotations

import struct

from .checksums import ogg_crc
from .model import Media, MediaError, Packet, Track
from .tags import vorbis_comments

OPUS_FRAME = {0: 480, 1: 960, 2: 1920, 3: 2880}


def is_ogg(data: bytes) -> bool:
    return data[:4] == b"OggS"


def opus_duration(packet: bytes) -> int:
    """Samples at 48 kHz that an Opus packet holds, from its first bytes."""
    if not packet:
        return 0
    config, count = packet[0] >> 3, packet[0] & 3
    frame = OPUS_FRAME[config & 3] if config < 12 else (480, 960)[config & 1] if config < 16 else 120 << (config & 3)
    frames = 1 if count == 0 else 2 if count < 3 else (packet[1] & 63 if len(packet) > 1 else 0)
    return frame * frames


def pages(data: bytes):
    """Serial, flags, granule and (offset, length, complete) of the packets' parts, page by page; pages whose checksum fails are skipped."""
    at = 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            return
        flags, granule, serial = data[at + 5], struct.unpack_from("<q", data, at + 6)[0], struct.unpack_from("<I", data, at + 14)[0]
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end > len(data) or ogg_crc(data[at:end]) != struct.unpack_from("<I", data, at + 22)[0]:
            at += 4
            continue
        parts, start, size = [], at + 27 + n, 0
        for x in lacing:
            size += x
            if x < 255:
                parts.append((start, size, True))
                start, size = start + size, 0
        if size:
            parts.append((start, size, False))
        yield serial, flags, granule, parts
        at = end


def parse(data: bytes) -> Media:
    streams: dict[int, dict] = {}
    tags: dict[str, str] = {}
    for serial, flags, granule, parts in pages(data):
        s = streams.setdefault(serial, {"packets": [], "open": b"", "marks": []})
        if not flags & 1:
            s["open"] = b""
        for start, size, done in parts:
            body = s["open"] + data[start : start + size]
            if not done:
                s["open"] = body
                continue
            one = not s["open"]
            s["open"] = b""
            s["packets"].append((start if one else -1, body))
        if granule >= 0:
            s["marks"].append((len(s["packets"]), granule))
    tracks = []
    for i, s in enumerate(streams.values()):
        first = s["packets"][0][1] if s["packets"] else b""
        if first[:8] == b"OpusHead":
            skip = struct.unpack_from("<H", first, 10)[0]
            track = Track(i + 1, "audio", "opus", 48000.0, channels=first[9], sample_rate=48000, codec_string="opus", description=first)
            heads, now = 2, -skip
            if len(s["packets"]) > 1 and s["packets"][1][1][:8] == b"OpusTags":
                tags.update(vorbis_comments(s["packets"][1][1][8:]))
            for offset, body in s["packets"][heads:]:
                n = opus_duration(body)
                track.packets.append(Packet(len(track.packets), now, n, offset, len(body), data=body if offset < 0 else None))
                now += n
        elif first[:7] == b"\x01vorbis":
            channels, rate = first[11], struct.unpack_from("<I", first, 12)[0]
            track = Track(i + 1, "audio", "vorbis", float(rate), channels=channels, sample_rate=rate, codec_string="vorbis", description=first)
            if len(s["packets"]) > 1 and s["packets"][1][1][:7] == b"\x03vorbis":
                tags.update(vorbis_comments(s["packets"][1][1][7:]))
            # Between two pages' granules the packets of a page share its time.
            done, now = 3, 0
            for upto, granule in s["marks"]:
                count = upto - done
                if count <= 0:
                    continue
                for k in range(count):
                    offset, body = s["packets"][done + k]
                    a, b = now + (granule - now) * k // count, now + (granule - now) * (k + 1) // count
                    track.packets.append(Packet(len(track.packets), a, b - a, offset, len(body), data=body if offset < 0 else None))
                done, now = upto, granule
        else:
            continue
        track.duration_ticks = max((p.ticks + p.duration_ticks for p in track.packets), default=0)
        tracks.append(track)
    if not tracks:
        raise MediaError("no known stream")
    return Media("ogg", tracks, tags)


def build(heads: list[bytes], packets: list[tuple[bytes, int]], serial: int = 1, most: int = 8) -> bytes:
    """A stream of header packets and (packet, granule at its end); up to ``most`` packets a page."""
    out = bytearray()
    groups = [[(heads[0], 0)], *([[(h, 0) for h in heads[1:]]] if heads[1:] else []), *(packets[i : i + most] for i in range(0, len(packets), most))]
    number = 0
    for g, group in enumerate(groups):
        # Packets longer than a page's lacing run on into the next page.
        lacing, body = [], b"".join(p for p, _ in group)
        for p, _ in group:
            lacing += [255] * (len(p) // 255) + [len(p) % 255]
        at, granule, going = 0, group[-1][1], False
        for k in range(0, len(lacing), 255):
            part = lacing[k : k + 255]
            size, final = sum(part), k + 255 >= len(lacing)
            flags = (1 if going else 0) | (2 if number == 0 else 0) | (4 if final and g == len(groups) - 1 else 0)
            page = b"OggS\0" + struct.pack("<BqIII", flags, granule if final else -1, serial, number, 0) + bytes([len(part), *part]) + body[at : at + size]
            out += page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:]
            at, number, going = at + size, number + 1, part[-1] == 255
    return bytes(out)

"""MPEG transport streams: read and written."""

from __future__ import annotations

import struct

from .checksums import mpeg_crc
from .model import Media, MediaError, Packet, Track
from .mpeg_audio import adts_header, audio_specific_config, mp3_header

CODECS = {0x1B: ("video", "avc"), 0x24: ("video", "hevc"), 0x0F: ("audio", "aac"), 0x03: ("audio", "mp3"), 0x04: ("audio", "mp3"), 0x81: ("audio", "ac3"), 0x87: ("audio", "eac3"), 0x82: ("audio", "dts")}
CLOCK = 90_000


def layout(data: bytes) -> tuple[int, int] | None:
    """The first packet's place and how far packets are apart: 188 bytes, with a time before each (192) or a check after it (204)."""
    for first, step in ((0, 188), (4, 192), (0, 204)):
        if len(data) >= first + 188 and all(data[i] == 0x47 for i in range(first, min(len(data) - 1, first + step * 4), step)):
            return first, step
    return None


def is_mpegts(data: bytes) -> bool:
    return layout(data) is not None


def timestamp(data: bytes) -> int:
    """The 33 bits of a time in five bytes."""
    return (data[0] >> 1 & 7) << 30 | data[1] << 22 | (data[2] >> 1) << 15 | data[3] << 7 | data[4] >> 1


def _stamp(kind: int, ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([kind << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def nal_types(codec: str, data: bytes) -> list[int]:
    """Types of the units behind start codes."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0 and at + 3 < len(data):
        out.append(data[at + 3] & 31 if codec == "avc" else data[at + 3] >> 1 & 63)
        at = data.find(b"\0\0\1", at + 3)
    return out


def is_key(codec: str, data: bytes) -> bool:
    kinds = nal_types(codec, data)
    return 5 in kinds if codec == "avc" else any(16 <= k <= 23 for k in kinds)


def parse(data: bytes) -> Media:
    found = layout(data)
    if found is None:
        raise MediaError("not a transport stream")
    if found != (0, 188):
        first, step = found
        data = b"".join(data[i : i + 188] for i in range(first, len(data) - 187, step))
    maps: set[int] = set()
    kinds: dict[int, tuple[str, str]] = {}
    order: list[int] = []
    units: dict[int, list[list]] = {}
    for at in range(0, len(data) - 187, 188):
        if data[at] != 0x47:
            raise MediaError(f"no packet at {at}")
        pid, starts, fields = (data[at + 1] & 31) << 8 | data[at + 2], data[at + 1] & 0x40, data[at + 3] >> 4 & 3
        p = at + 4
        if fields & 2:
            p += 1 + data[p]
        if not fields & 1 or p >= at + 188:
            continue
        body = data[p : at + 188]
        if pid == 0 or pid in maps:
            if not starts:
                continue
            section = body[1 + body[0] :]
            size = ((section[1] & 15) << 8 | section[2]) + 3
            if size > len(section) or mpeg_crc(section[:size]):
                continue
            if pid == 0:
                maps |= {(section[i + 2] & 31) << 8 | section[i + 3] for i in range(8, size - 4, 4) if section[i] or section[i + 1]}
            else:
                i = 12 + ((section[10] & 15) << 8 | section[11])
                while i + 5 <= size - 4:
                    one = (section[i + 1] & 31) << 8 | section[i + 2]
                    if section[i] in CODECS and one not in kinds:
                        kinds[one] = CODECS[section[i]]
                        order.append(one)
                    i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
        elif pid in kinds:
            if starts:
                units.setdefault(pid, []).append([at, bytearray(body)])
            elif units.get(pid):
                units[pid][-1][1] += body
    tracks = []
    for n, pid in enumerate(order):
        kind, codec = kinds[pid]
        t = Track(n + 1, kind, codec, float(CLOCK), codec_string=codec, internal_codec_id=hex(pid))
        wrap = last = 0
        for at, raw in units.get(pid, []):
            if raw[:3] != b"\0\0\1" or len(raw) < 9 or not raw[7] & 0x80:
                continue
            pts = timestamp(raw[9:14])
            if pts + wrap < last - (1 << 32):  # 33 bits have run over
                wrap += 1 << 33
            pts += wrap
            last = max(last, pts)
            size = int.from_bytes(raw[4:6], "big")
            body = bytes(raw[9 + raw[8] : 6 + size if size else len(raw)])
            if codec in ("aac", "mp3"):
                p, k = 0, 0
                while h := (adts_header(body, p) if codec == "aac" else mp3_header(body, p)):
                    if p + h["size"] > len(body):
                        break
                    frames = 1024 if codec == "aac" else h["samples"]
                    if t.sample_rate is None:
                        t.sample_rate, t.channels = h["rate"], h["channels"]
                        t.description = audio_specific_config(h["object_type"], h["rate"], h["channels"]) if codec == "aac" else None
                    head = h["head"] if codec == "aac" else 0
                    a, b = (pts + round(i * frames * CLOCK / h["rate"]) for i in (k, k + 1))
                    t.packets.append(Packet(len(t.packets), a, b - a, at, h["size"] - head, True, body[p + head : p + h["size"]]))
                    p, k = p + h["size"], k + 1
            else:
                t.packets.append(Packet(len(t.packets), pts, 0, at, len(body), kind != "video" or is_key(codec, body), body))
        times = sorted({p.ticks for p in t.packets})
        after = dict(zip(times, times[1:], strict=False))
        step = times[-1] - times[-2] if len(times) > 1 else 0
        for p in t.packets:
            p.duration_ticks = p.duration_ticks or after.get(p.ticks, p.ticks + step) - p.ticks
        tracks.append(t)
    if not tracks:
        raise MediaError("no known stream")
    return Media("mpegts", tracks)


def build(tracks: list[Track], payloads: dict[int, list[bytes]]) -> bytes:
    """One program; packets of all tracks in the order of a merge by time. Payloads are as the stream holds them (start codes, ADTS headers)."""
    stream = {v: k for k, v in reversed(CODECS.items())}
    counters: dict[int, int] = {}
    out = bytearray()

    def packets(pid: int, body: bytes, clock: int | None = None) -> None:
        first = True
        while first or body:
            n = counters[pid] = (counters.get(pid, -1) + 1) & 15
            field = b"\x50" + struct.pack(">IH", (clock >> 1) & 0xFFFFFFFF, (clock & 1) << 15 | 0x7E00) if first and clock is not None else b""
            room = 184 - (len(field) + 1 if field else 0)
            part, body = body[:room], body[room:]
            fill = room - len(part)
            if fill and not field:
                field, fill = (b"" if fill == 1 else b"\0"), max(0, fill - 2)
                extra = bytes([len(field) + fill]) + field + b"\xff" * fill
            else:
                extra = bytes([len(field) + fill]) + field + b"\xff" * fill if field else b""
            out.extend(bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255, (0x30 if extra else 0x10) | n]) + extra + part)
            first = False

    def section(table: int, body: bytes) -> bytes:
        s = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + b"\0\1\xc1\0\0" + body
        return b"\0" + s + struct.pack(">I", mpeg_crc(s))

    pids = {t.track_id: 0x100 + i for i, t in enumerate(tracks)}
    packets(0, section(0, b"\0\1\xf0\0"))
    entries = b"".join(bytes([stream[t.type, t.codec], 0xE0 | pids[t.track_id] >> 8, pids[t.track_id] & 255, 0xF0, 0]) for t in tracks)
    clock_pid = pids[tracks[0].track_id]
    packets(0x1000, section(2, bytes([0xE0 | clock_pid >> 8, clock_pid & 255, 0xF0, 0]) + entries))
    rows = []
    for k, t in enumerate(tracks):
        reach = -(1 << 62)
        from .isobmff import decode_ticks

        for p, d, dts in zip(t.packets, payloads[t.track_id], decode_ticks(t.packets), strict=True):
            pts, dts = round(p.ticks * CLOCK / t.resolution), round(dts * CLOCK / t.resolution)
            reach = max(reach, pts)
            rows.append((reach, k, p.seq, t, pts, dts, d, p.key))
    for _, k, _, t, pts, dts, body, key in sorted(rows, key=lambda r: r[:3]):
        stamps = _stamp(3, pts) + _stamp(1, dts) if dts != pts else _stamp(2, pts)
        size = len(body) + 3 + len(stamps)
        pes = b"\0\0\1" + bytes([0xE0 if t.type == "video" else 0xC0]) + struct.pack(">H", size if size < 65536 and t.type != "video" else 0) + bytes([0x80, 0xC0 if dts != pts else 0x80, len(stamps)]) + stamps + body
        packets(pids[t.track_id], pes, dts if k == 0 and key else None)
    return bytes(out)

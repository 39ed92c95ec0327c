"""Matroska and WebM: read with lacing and block groups; a plain file, written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from .model import Media, MediaError, Packet, Track

CODECS = {"V_MPEG4/ISO/AVC": "avc", "V_MPEGH/ISO/HEVC": "hevc", "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_PRORES": "prores", "A_AAC": "aac", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_MPEG/L3": "mp3", "A_AC3": "ac3", "A_EAC3": "eac3", "A_DTS": "dts", "S_TEXT/WEBVTT": "webvtt", "D_WEBVTT/SUBTITLES": "webvtt"}
MASTERS = {0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x1F43B675, 0xA0, 0x1254C367, 0x7373, 0x67C8, 0x55B0, 0x7670}
TAG_NAMES = {"TITLE": "title", "DESCRIPTION": "description", "ARTIST": "artist", "ALBUM": "album", "ALBUM_ARTIST": "album_artist", "GENRE": "genre", "COMMENT": "comment", "LYRICS": "lyrics", "DATE": "date", "DATE_RELEASED": "date", "PART_NUMBER": "track"}


def is_matroska(data: bytes) -> bool:
    return data[:4] == b"\x1a\x45\xdf\xa3"


def number(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """A variable-length number and the place after it; None for "unknown"."""
    first = data[at]
    if not first:
        raise MediaError("a number of over eight bytes")
    n = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end and data[at]:
        try:
            name, p = number(data, at, keep=True)
            size, p = number(data, p)
        except (IndexError, MediaError):
            return
        stop = end if size is None else min(p + size, end)
        if size is None and name == 0x1F43B675:  # a live cluster ends where the next one begins
            q = p
            while q < end:
                inner, r = number(data, q, keep=True)
                length, r = number(data, r)
                if inner in (0x1F43B675, 0x1C53BB6B, 0x1254C367, 0x1549A966, 0x1654AE6B) or length is None:
                    break
                q = r + length
            stop = min(q, end)
        yield name, p, stop
        at = stop


#: Elements that stand directly in a segment.
PARTS = (0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1254C367, 0x1043A770, 0x1941A469)
FILLERS = (0xEC, 0xBF)


def _resynchronised(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """The parts of a segment; after damage it goes on with the next cluster that can be found."""
    while at < end:
        for name, a, b in elements(data, at, end):
            if name not in PARTS and name not in FILLERS:
                break
            yield name, a, b
            at = b
        if at < end:
            at = data.find(b"\x1f\x43\xb6\x75", at + 1, end)
            if at < 0:
                return


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Places and sizes of a block's frames."""
    if not kind:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        each = (end - at) // count
        return [(at + i * each, each) for i in range(count)]
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
            sizes.append(n)
    else:
        n, at = number(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            start = at
            d, at = number(data, at)
            sizes.append(sizes[-1] + d - ((1 << (7 * (at - start) - 1)) - 1))
    sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes[:count]:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> Media:
    if not is_matroska(data):
        raise MediaError("not a Matroska file")
    kind, scale, length = "mkv", 1_000_000, None
    tracks: dict[int, Track] = {}
    steps: dict[int, int] = {}
    stripped: dict[int, bytes] = {}  # what packets begin with, left out of the file
    squeezed: set[int] = set()  # tracks with zlib packets
    tags: dict[str, str] = {}

    def block(a: int, b: int, cluster: int, key: bool | None, duration: int | None) -> None:
        no, p = number(data, a)
        t = tracks.get(no)
        if t is None:
            return
        shift, flags = struct.unpack_from(">hB", data, p)
        if key is None:
            key = bool(flags & 0x80)
        frames = _laced(data, p + 3, b, flags >> 1 & 3)
        each = steps.get(no) or (duration or 0) // len(frames)
        for i, (at, n) in enumerate(frames):
            body = None
            if no in squeezed:
                body = zlib.decompress(data[at : at + n])
            elif no in stripped:
                body = stripped[no] + data[at : at + n]
            t.packets.append(Packet(len(t.packets), cluster + shift + i * each, each, at, n if body is None else len(body), key or t.type != "video", body))

    def track(a: int, b: int) -> None:
        t = Track(0, "", None, 1e9 / scale)
        step, method, settings = 0, None, b""
        for name, x, y in elements(data, a, b):
            if name == 0xD7:
                t.track_id = _uint(data, x, y)
            elif name == 0x83:
                t.type = {1: "video", 2: "audio", 17: "subtitle"}.get(_uint(data, x, y), "")
            elif name == 0x86:
                t.internal_codec_id = data[x:y].split(b"\0")[0].decode("latin-1")
            elif name == 0x63A2:
                t.description = data[x:y]
            elif name in (0x22B59C, 0x22B59D):
                t.language = data[x:y].split(b"\0")[0].decode("latin-1")[:3] or "und"
            elif name == 0x536E:
                t.name = data[x:y].decode("utf-8", "replace")
            elif name == 0x23E383:
                step = _uint(data, x, y)
            elif name == 0x88:
                t.default = bool(_uint(data, x, y))
            elif name == 0x6D80:  # encodings: only a compression is undone
                for n, p, q in elements(data, x, y):
                    for m, u, v in elements(data, p, q) if n == 0x6240 else ():
                        if m == 0x5034:
                            method = 0
                            for k, c, d in elements(data, u, v):
                                if k == 0x4254:
                                    method = _uint(data, c, d)
                                elif k == 0x4255:
                                    settings = data[c:d]
            elif name == 0xE0:
                for n, p, q in elements(data, x, y):
                    if n == 0xB0:
                        t.width = _uint(data, p, q)
                    elif n == 0xBA:
                        t.height = _uint(data, p, q)
            elif name == 0xE1:
                for n, p, q in elements(data, x, y):
                    if n == 0xB5:
                        t.sample_rate = int(_float(data, p, q))
                    elif n == 0x9F:
                        t.channels = _uint(data, p, q)
                    elif n == 0x6264:
                        t.rotation = 0
                        t.codec_string = str(_uint(data, p, q))
        if t.type:
            ident = t.internal_codec_id or ""
            bits = t.codec_string if t.type == "audio" and (t.codec_string or "").isdigit() else "16"
            t.codec = CODECS.get(ident) or ("aac" if ident.startswith("A_AAC") else f"pcm-s{bits}" if ident == "A_PCM/INT/LIT" else f"pcm-s{bits}be" if ident == "A_PCM/INT/BIG" else f"pcm-f{bits}" if ident == "A_PCM/FLOAT/IEEE" else None)
            t.codec_string = t.codec
            if t.type == "audio":
                t.channels = t.channels or 1
            tracks[t.track_id] = t
            if method == 3:
                stripped[t.track_id] = bytes(settings)
            elif method == 0:
                squeezed.add(t.track_id)
            if step:
                steps[t.track_id] = round(step / scale)

    for name, a, b in elements(data, 0, len(data)):
        if name == 0x1A45DFA3:
            for n, x, y in elements(data, a, b):
                if n == 0x4282:
                    kind = "webm" if data[x:y].split(b"\0")[0] == b"webm" else "mkv"
        if name != 0x18538067:
            continue
        for part, x, y in _resynchronised(data, a, b):
            if part == 0x1549A966:
                for n, p, q in elements(data, x, y):
                    if n == 0x2AD7B1:
                        scale = _uint(data, p, q)
                    elif n == 0x4489:
                        length = _float(data, p, q)
                    elif n == 0x7BA9:
                        tags["title"] = data[p:q].decode("utf-8", "replace")
            elif part == 0x1654AE6B:
                for n, p, q in elements(data, x, y):
                    if n == 0xAE:
                        track(p, q)
            elif part == 0x1F43B675:
                now = 0
                for n, p, q in elements(data, x, y):
                    if n == 0xE7:
                        now = _uint(data, p, q)
                    elif n == 0xA3:
                        block(p, q, now, None, None)
                    elif n == 0xA0:
                        inner = list(elements(data, p, q))
                        lasting = next((_uint(data, u, v) for m, u, v in inner if m == 0x9B), None)
                        refers = any(m == 0xFB for m, _, _ in inner)
                        for m, u, v in inner:
                            if m == 0xA1:
                                block(u, v, now, not refers, lasting)
            elif part == 0x1254C367:
                for n, p, q in elements(data, x, y):
                    if n == 0x7373:
                        for m, u, v in elements(data, p, q):
                            if m == 0x67C8:
                                pair = {k: data[c:d].split(b"\0")[0].decode("utf-8", "replace") for k, c, d in elements(data, u, v) if k in (0x45A3, 0x4487)}
                                if pair.get(0x45A3, "").upper() in TAG_NAMES and 0x4487 in pair:
                                    tags.setdefault(TAG_NAMES[pair[0x45A3].upper()], pair[0x4487])
    for t in tracks.values():
        t.duration_ticks = round(length) if length else None
        for i, p in enumerate(t.packets):  # without a duration a packet lasts to the next one presented
            if not p.duration_ticks:
                later = [x.ticks for x in t.packets[i + 1 : i + 17] if x.ticks > p.ticks]
                p.duration_ticks = min(later) - p.ticks if later else 0
    return Media(kind, list(tracks.values()), tags)


def _element(name: int, body: bytes) -> bytes:
    size = len(body)
    width = next(n for n in range(1, 9) if size < (1 << 7 * n) - 1)
    return name.to_bytes(-(-name.bit_length() // 8), "big") + (size | 1 << 7 * width).to_bytes(width, "big") + body


def _int(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, -(-value.bit_length() // 8)), "big"))


def build(tracks: list[Track], payloads: dict[int, list[bytes]], tags: dict[str, str] | None = None, webm: bool = False, cluster_ms: int = 1000) -> bytes:
    """Clusters open at key packets, at most 32 s apart; packets of all tracks in the order of a merge by time. Times are milliseconds."""
    names = {v: k for k, v in reversed(CODECS.items())}
    ms = lambda t, ticks: round(ticks * 1000 / t.resolution)
    entries = []
    for t in tracks:
        body = _int(0xD7, t.track_id) + _int(0x73C5, t.track_id) + _int(0x83, {"video": 1, "audio": 2, "subtitle": 17}[t.type])
        ident = names.get(t.codec or "") or ("A_PCM/FLOAT/IEEE" if (t.codec or "").startswith("pcm-f") else "A_PCM/INT/BIG" if (t.codec or "").endswith("be") else "A_PCM/INT/LIT")
        body += _element(0x86, ident.encode()) + _element(0x22B59C, t.language.encode()) + _int(0x88, int(t.default))
        if t.description:
            body += _element(0x63A2, t.description)
        if t.type == "video":
            body += _element(0xE0, _int(0xB0, t.width or 0) + _int(0xBA, t.height or 0))
        elif t.type == "audio":
            bits = (t.codec or "").removeprefix("pcm-")[1:].removesuffix("be")
            body += _element(0xE1, _element(0xB5, struct.pack(">d", t.sample_rate or 0)) + _int(0x9F, t.channels or 1) + (_int(0x6264, int(bits)) if bits.isdigit() else b""))
        entries.append(_element(0xAE, body))
    rows = []
    for k, t in enumerate(tracks):
        reach = -(1 << 62)
        for p, d in zip(t.packets, payloads[t.track_id], strict=True):
            reach = max(reach, ms(t, p.ticks))
            rows.append((reach, k, p.seq, t, p, d))
    rows.sort(key=lambda r: r[:3])
    clusters, start, body = [], None, b""
    video = any(t.type == "video" for t in tracks)
    for _, _, _, t, p, d in rows:
        at = ms(t, p.ticks)
        opens = start is None or at - start > 32_000 or (at - start >= cluster_ms and p.key and (t.type == "video" or not video))
        if opens:
            if start is not None:
                clusters.append(_element(0x1F43B675, _int(0xE7, max(0, start)) + body))
            start, body = at, b""
        head = (t.track_id | 0x80).to_bytes(1, "big") + struct.pack(">h", at - max(0, start))
        if p.duration_ticks:
            group = _element(0xA1, head + b"\0" + d) + _int(0x9B, ms(t, p.ticks + p.duration_ticks) - at)
            body += _element(0xA0, group + (b"" if p.key else _element(0xFB, b"\xff")))
        else:
            body += _element(0xA3, head + (b"\x80" if p.key else b"\0") + d)
    if start is not None:
        clusters.append(_element(0x1F43B675, _int(0xE7, max(0, start)) + body))
    longest = max([0, *(ms(t, p.ticks + p.duration_ticks) for t in tracks for p in t.packets)])
    info = _int(0x2AD7B1, 1_000_000) + _element(0x4489, struct.pack(">d", longest)) + _element(0x4D80, b"tidemark") + _element(0x5741, b"tidemark")
    tag_names = {}
    for k, v in TAG_NAMES.items():
        tag_names.setdefault(v, k)
    simple = b"".join(_element(0x67C8, _element(0x45A3, tag_names[k].encode()) + _element(0x4487, v.encode())) for k, v in (tags or {}).items() if k in tag_names)
    tagged = _element(0x1254C367, _element(0x7373, _element(0x63C0, b"") + simple)) if simple else b""
    head = _element(0x1A45DFA3, _int(0x4286, 1) + _int(0x42F7, 1) + _int(0x42F2, 4) + _int(0x42F3, 8) + _element(0x4282, b"webm" if webm else b"matroska") + _int(0x4287, 4) + _int(0x4285, 2))
    return head + _element(0x18538067, _element(0x1549A966, info) + _element(0x1654AE6B, b"".join(entries)) + b"".join(clusters) + tagged)

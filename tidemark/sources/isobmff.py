"""MP4 and MOV: sample tables and fragments, read; a plain file with sample tables, written."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import replace

from .model import Media, MediaError, Packet, Track
from .mpeg_audio import parse_audio_specific_config

VIDEO = {"avc1": "avc", "avc3": "avc", "hvc1": "hevc", "hev1": "hevc", "vp08": "vp8", "vp09": "vp9", "av01": "av1", "apch": "prores", "apcn": "prores", "apcs": "prores", "apco": "prores", "ap4h": "prores", "ap4x": "prores"}
AUDIO = {"mp4a": "aac", "Opus": "opus", "fLaC": "flac", "ac-3": "ac3", "ec-3": "eac3", ".mp3": "mp3", "sowt": "pcm-s16", "twos": "pcm-s16be", "in24": "pcm-s24be", "in32": "pcm-s32be", "fl32": "pcm-f32be", "fl64": "pcm-f64be", "raw ": "pcm-u8", "ulaw": "ulaw", "alaw": "alaw"}
TAG_NAMES = {b"\xa9nam": "title", b"\xa9ART": "artist", b"\xa9alb": "album", b"aART": "album_artist", b"\xa9cmt": "comment", b"\xa9gen": "genre", b"\xa9day": "date", b"\xa9lyr": "lyrics", b"desc": "description"}


def _take(form: str, data: bytes, at: int = 0) -> tuple:
    """Fields at a place; data may be anything that gives bytes for a slice, so that only what is asked for is read."""
    body = data[at : at + struct.calcsize(form)]
    if len(body) < struct.calcsize(form):
        raise MediaError("the data ends within a field")
    return struct.unpack(form, body)


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of the contents of each box."""
    while at + 8 <= end:
        size, name = _take(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = _take(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def find(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for name in path:
        hit = next(((a, b) for n, a, b in boxes(data, at, end) if n == name), None)
        if hit is None:
            return None
        at, end = hit
    return at, end


def is_isobmff(data: bytes) -> bool:
    return data[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"styp", b"moof")


def _table(data: bytes, stbl: tuple[int, int], name: bytes, form: str) -> list[tuple]:
    hit = find(data, *stbl, name)
    if not hit:
        return []
    (n,) = _take(">I", data, hit[0] + 4)
    n = min(n, (hit[1] - hit[0] - 8) // struct.calcsize(form))
    return list(struct.iter_unpack(form, data[hit[0] + 8 : hit[0] + 8 + n * struct.calcsize(form)]))


def _description(data: bytes, track: Track, a: int, b: int) -> None:
    """The first sample description."""
    for name, at, end in boxes(data, a + 8, b):
        kind = name.decode("latin-1")
        track.internal_codec_id = kind
        if track.type == "video":
            track.codec = VIDEO.get(kind)
            track.width, track.height = _take(">HH", data, at + 24)
            for n, x, y in boxes(data, at + 78, end):
                if n in (b"avcC", b"hvcC", b"vpcC", b"av1C"):
                    track.description = data[x:y]
                    if n == b"avcC" and y - x >= 4:
                        track.codec_string = "avc1." + data[x + 1 : x + 4].hex()
        elif track.type == "audio":
            track.codec = AUDIO.get(kind)
            version = _take(">H", data, at + 8)[0]
            track.channels, bits = _take(">HH", data, at + 16)
            track.sample_rate = _take(">I", data, at + 24)[0] >> 16
            inner = at + 28 + {1: 16, 2: 36}.get(version, 0)
            if kind in ("sowt", "twos") and bits == 8:
                track.codec = "pcm-s8"
            for n, x, y in boxes(data, inner, end):
                if n == b"esds":
                    _elementary(data[x + 4 : y], track)
                elif n in (b"dOps", b"dfLa", b"dac3", b"dec3", b"alac"):
                    track.description = data[x:y]
            track.codec_string = track.codec_string or track.codec
        elif kind == "wvtt":
            track.codec = "webvtt"
        return


def _elementary(body: bytes, track: Track) -> None:
    """Descriptors of an MPEG-4 elementary stream: the object type and the decoder's own description."""
    at = 0
    while at + 2 <= len(body):
        tag, at, size = body[at], at + 1, 0
        while at < len(body):
            size = size << 7 | body[at] & 0x7F
            at += 1
            if not body[at - 1] & 0x80:
                break
        if tag == 3:
            at += 3
        elif tag == 4:
            kind = body[at]
            track.codec = {0x6B: "mp3", 0x69: "mp3", 0xDD: "vorbis"}.get(kind, "aac")
            at += 13
        elif tag == 5:
            track.description = body[at : at + size]
            if track.codec == "aac":
                c = parse_audio_specific_config(track.description)
                track.codec_string = f"mp4a.40.{c['object_type']}"
                track.sample_rate, track.channels = c["rate"] or track.sample_rate, c["channels"] or track.channels
            return
        else:
            at += size


def _rotation(matrix: tuple[int, ...]) -> int:
    a, b = matrix[0] >> 16, matrix[1] >> 16
    return {(1, 0): 0, (0, 1): 90, (-1, 0): 180, (0, -1): 270}.get((a, b), 0)


def _samples(data: bytes, track: Track, stbl: tuple[int, int]) -> None:
    """Expands the tables' runs into packets."""
    sizes = find(data, *stbl, b"stsz")
    if not sizes:
        return
    fixed, count = _take(">II", data, sizes[0] + 4)
    length = [fixed] * count if fixed else list(_take(f">{count}I", data, sizes[0] + 12))
    times = [d for n, d in _table(data, stbl, b"stts", ">II") for _ in range(n)]
    shifts = [d for n, d in _table(data, stbl, b"ctts", ">Ii") for _ in range(n)]
    keys = {i - 1 for (i,) in _table(data, stbl, b"stss", ">I")} if find(data, *stbl, b"stss") else None
    chunks = [x for (x,) in _table(data, stbl, b"stco", ">I")] or [x for (x,) in _table(data, stbl, b"co64", ">Q")]
    runs = _table(data, stbl, b"stsc", ">III")
    i = now = 0
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
        for c in range(first, last):
            at = chunks[c - 1]
            for _ in range(per):
                if i >= count:
                    return
                d = times[i] if i < len(times) else 0
                track.packets.append(Packet(i, now + (shifts[i] if i < len(shifts) else 0), d, at, length[i], keys is None or i in keys))
                at, now, i = at + length[i], now + d, i + 1


def _fragments(data: bytes, tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    clock: dict[int, int] = {}
    for name, a, b in boxes(data, 0, len(data)):
        if name != b"moof":
            continue
        for kind, x, y in boxes(data, a, b):
            if kind != b"traf":
                continue
            head = find(data, x, y, b"tfhd")
            flags, number = _take(">II", data, head[0])
            flags &= 0xFFFFFF
            track = tracks.get(number)
            if track is None:
                continue
            at, base = head[0] + 8, a - 8
            if flags & 1:
                base, at = _take(">Q", data, at)[0], at + 8
            if flags & 2:
                at += 4
            d = list(defaults.get(number, (0, 0, 0)))
            for bit, i in ((8, 0), (16, 1), (32, 2)):
                if flags & bit:
                    d[i], at = _take(">I", data, at)[0], at + 4
            if hit := find(data, x, y, b"tfdt"):
                clock[number] = _take(">Q" if data[hit[0]] else ">I", data, hit[0] + 4)[0]
            now, place = clock.get(number, 0), base
            for n, p, _ in boxes(data, x, y):
                if n != b"trun":
                    continue
                version, f = data[p], _take(">I", data, p)[0] & 0xFFFFFF
                (count,) = _take(">I", data, p + 4)
                p += 8
                if f & 1:
                    place, p = base + _take(">i", data, p)[0], p + 4
                first = None
                if f & 4:
                    first, p = _take(">I", data, p)[0], p + 4
                for i in range(count):
                    values = list(d)
                    for bit, k in ((0x100, 0), (0x200, 1), (0x400, 2)):
                        if f & bit:
                            values[k], p = _take(">I", data, p)[0], p + 4
                    shift = 0
                    if f & 0x800:
                        shift, p = _take(">i" if version else ">I", data, p)[0], p + 4
                    mark = first if first is not None and i == 0 else values[2]
                    track.packets.append(Packet(len(track.packets), now + shift, values[0], place, values[1], not mark & 0x10000))
                    now, place = now + values[0], place + values[1]
            clock[number] = now


def parse(data: bytes) -> Media:
    moov = find(data, 0, len(data), b"moov")
    if not moov:
        raise MediaError("no moov box")
    brand = find(data, 0, len(data), b"ftyp")
    quick = bool(brand) and data[brand[0] : brand[0] + 4] == b"qt  "
    tracks: dict[int, Track] = {}
    for name, a, b in boxes(data, *moov):
        if name != b"trak":
            continue
        tkhd, mdhd, hdlr, stbl = find(data, a, b, b"tkhd"), find(data, a, b, b"mdia", b"mdhd"), find(data, a, b, b"mdia", b"hdlr"), find(data, a, b, b"mdia", b"minf", b"stbl")
        if not (tkhd and mdhd and hdlr and stbl):
            continue
        long = data[tkhd[0]] == 1
        (number,) = _take(">I", data, tkhd[0] + (20 if long else 12))
        matrix = _take(">9i", data, tkhd[0] + (52 if long else 40))
        scale, length = _take(">IQ" if data[mdhd[0]] else ">II", data, mdhd[0] + (20 if data[mdhd[0]] else 12))
        (packed,) = _take(">H", data, mdhd[0] + (32 if data[mdhd[0]] else 20))
        kind = {b"vide": "video", b"soun": "audio", b"text": "subtitle", b"subt": "subtitle"}.get(data[hdlr[0] + 8 : hdlr[0] + 12])
        if kind is None or not scale:
            continue
        language = "".join(chr(0x60 + (packed >> s & 31)) for s in (10, 5, 0)) if packed < 0x8000 and packed else "und"
        t = Track(number, kind, None, float(scale), language=language, rotation=_rotation(matrix), duration_ticks=length or None, default=bool(data[tkhd[0] + 3] & 1))
        if stsd := find(data, *stbl, b"stsd"):
            _description(data, t, *stsd)
        _samples(data, t, stbl)
        tracks[number] = t
    defaults = {}
    if mvex := find(data, *moov, b"mvex"):
        for name, a, _ in boxes(data, *mvex):
            if name == b"trex":
                number, _, d, s, f = _take(">5I", data, a + 4)
                defaults[number] = (d, s, f)
    _fragments(data, tracks, defaults)
    tags = {}
    if meta := find(data, *moov, b"udta", b"meta"):
        if ilst := find(data, meta[0] + 4, meta[1], b"ilst"):
            for name, a, b in boxes(data, *ilst):
                if value := find(data, a, b, b"data"):
                    body = data[value[0] + 8 : value[1]]
                    if name in TAG_NAMES:
                        tags[TAG_NAMES[name]] = body.decode("utf-8", "replace")
                    elif name in (b"trkn", b"disk") and len(body) >= 6:
                        n, of = _take(">HH", body, 2)
                        tags[{b"trkn": "track", b"disk": "disc"}[name]] = f"{n}/{of}" if of else str(n)
    return Media("mov" if quick else "mp4", list(tracks.values()), tags)


def _box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def _full(name: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(name, struct.pack(">I", version << 24 | flags), *parts)


def _runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]


def decode_ticks(packets: list[Packet]) -> list[int]:
    """Within each group from key packet to key packet the i-th packet is decoded at the i-th least time."""
    out: list[int] = []
    group: list[int] = []
    for p in packets:
        if p.key and group:
            out += sorted(group)
            group = []
        group.append(p.ticks)
    return out + sorted(group)


def build(tracks: list[Track], payloads: dict[int, list[bytes]], tags: dict[str, str] | None = None) -> bytes:
    """An MP4 file: the tables first, then each track's packets in chunks of half a second, interleaved by time."""
    entries = {"avc": (b"avc1", b"avcC"), "hevc": (b"hvc1", b"hvcC"), "vp8": (b"vp08", b"vpcC"), "vp9": (b"vp09", b"vpcC"), "av1": (b"av01", b"av1C"), "aac": (b"mp4a", None), "opus": (b"Opus", b"dOps"), "flac": (b"fLaC", b"dfLa"), "pcm-s16": (b"sowt", None), "pcm-s16be": (b"twos", None)}
    chunks: list[tuple[float, int, list[int]]] = []
    dts = {t.track_id: decode_ticks(t.packets) for t in tracks}
    for t in tracks:
        group: list[int] = []
        for i in range(len(t.packets)):
            if group and dts[t.track_id][i] - dts[t.track_id][group[0]] >= t.resolution / 2:
                chunks.append((dts[t.track_id][group[0]] / t.resolution, t.track_id, group))
                group = []
            group.append(i)
        if group:
            chunks.append((dts[t.track_id][group[0]] / t.resolution, t.track_id, group))
    chunks.sort(key=lambda c: (c[0], c[1]))
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(start: int) -> bytes:
        at, places = start, {t.track_id: [] for t in tracks}
        for _, number, group in chunks:
            places[number].append((at, len(group)))
            at += sum(len(payloads[number][i]) for i in group)
        longest = max([0.0, *((max((p.ticks + p.duration_ticks for p in t.packets), default=0)) / t.resolution for t in tracks)])
        parts = [_full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, 1000, round(longest * 1000), 0x10000, 0x100), unity, bytes(24), struct.pack(">I", len(tracks) + 1))]
        for t in tracks:
            d = dts[t.track_id]
            end = max((p.ticks + p.duration_ticks for p in t.packets), default=0)
            steps = [d[i + 1] - d[i] if i + 1 < len(d) else t.packets[i].duration_ticks for i in range(len(d))]
            shifts = [p.ticks - x for p, x in zip(t.packets, d, strict=True)]
            name, config = entries[t.codec]
            extra = _box(config, t.description) if config and t.description else b""
            if t.codec == "aac":
                info = bytes([5, len(t.description or b"")]) + (t.description or b"")
                inner = bytes([4, 13 + len(info), 0x40, 0x15]) + bytes(11) + info
                extra = _full(b"esds", bytes([3, 3 + len(inner) + 3]) + b"\0\x01\0" + inner + b"\x06\x01\x02")
            if t.type == "video":
                entry = _box(name, bytes(6), struct.pack(">H16xHHIIIH32xHh", 1, t.width or 0, t.height or 0, 0x480000, 0x480000, 0, 1, 24, -1), extra)
            else:
                entry = _box(name, bytes(6), struct.pack(">H8xHHIHH", 1, t.channels or 0, 16, 0, min(t.sample_rate or 0, 65535), 0), extra)
            lang = sum((ord(c) - 0x60) << s for c, s in zip(t.language if len(t.language) == 3 else "und", (10, 5, 0), strict=True))
            per: list[tuple[int, int]] = []
            for k, (_, n) in enumerate(places[t.track_id]):
                if not per or per[-1][1] != n:
                    per.append((k + 1, n))
            big = any(x >= 1 << 32 for x, _ in places[t.track_id])
            table = lambda n, rows, form, version=0: _full(n, struct.pack(">I", len(rows)), *[struct.pack(form, *r) for r in rows], version=version)
            stbl = [_full(b"stsd", struct.pack(">I", 1), entry), table(b"stts", _runs(steps), ">II")]
            if any(shifts):
                stbl.append(table(b"ctts", _runs(shifts), ">Ii", 1))
            if not all(p.key for p in t.packets):
                stbl.append(table(b"stss", [(i + 1,) for i, p in enumerate(t.packets) if p.key], ">I"))
            stbl += [table(b"stsc", [(k, n, 1) for k, n in per], ">III"), _full(b"stsz", struct.pack(">II", 0, len(t.packets)), *[struct.pack(">I", len(x)) for x in payloads[t.track_id]]), table(b"co64" if big else b"stco", [(x,) for x, _ in places[t.track_id]], ">Q" if big else ">I")]
            media_head = _full(b"vmhd", bytes(8), flags=1) if t.type == "video" else _full(b"smhd", bytes(4))
            parts.append(_box(
                b"trak",
                _full(b"tkhd", struct.pack(">IIIII8xhhH2x", 0, 0, t.track_id, 0, round(end / t.resolution * 1000), 0, 0, 0x100 if t.type == "audio" else 0), unity, struct.pack(">II", (t.width or 0) << 16, (t.height or 0) << 16), flags=3 if t.default else 2),
                _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, int(t.resolution), end, lang, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide" if t.type == "video" else b"soun"), b"\0"),
                     _box(b"minf", media_head, _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", *stbl))),
            ))
        if tags:
            names = {v: k for k, v in TAG_NAMES.items()}
            items = [_box(names[k], _box(b"data", struct.pack(">II", 1, 0), v.encode())) for k, v in tags.items() if k in names]
            parts.append(_box(b"udta", _full(b"meta", _full(b"hdlr", struct.pack(">I4s12x", 0, b"mdir"), b"\0"), _box(b"ilst", *items))))
        return _box(b"moov", *parts)

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2avc1mp41")
    size = sum(len(x) for p in payloads.values() for x in p)
    wide = size + 16 >= 1 << 32
    first = len(head) + len(moov(0)) + (16 if wide else 8)
    data = (struct.pack(">I4sQ", 1, b"mdat", size + 16) if wide else struct.pack(">I4s", size + 8, b"mdat")) + b"".join(payloads[n][i] for _, n, g in chunks for i in g)
    return head + moov(first) + data


def initialisation(tracks: list[Track], tags: dict[str, str] | None = None) -> bytes:
    """What stands before the fragments: the tracks without packets."""
    bare = [replace(t, packets=[]) for t in tracks]
    whole = build(bare, {t.track_id: [] for t in tracks}, tags)
    a, b = find(whole, 0, len(whole), b"moov")
    extends = _box(b"mvex", *[_full(b"trex", struct.pack(">5I", t.track_id, 1, 0, 0, 0)) for t in tracks])
    return _box(b"ftyp", b"iso5", struct.pack(">I", 0x200), b"iso5iso6mp41cmfc") + _box(b"moov", whole[a:b], extends)


def fragment(number: int, tracks: list[Track], payloads: dict[int, list[bytes]], parts: dict[int, tuple[int, int]], dts: dict[int, list[int]]) -> bytes:
    """One fragment: of each track the packets from parts[track][0] up to parts[track][1]."""

    def moof(size: int) -> bytes:
        at, trafs = size + 8, []
        for t in tracks:
            first, last = parts.get(t.track_id, (0, 0))
            if first == last:
                continue
            d = dts[t.track_id]
            rows = []
            for i in range(first, last):
                p = t.packets[i]
                step = d[i + 1] - d[i] if i + 1 < len(d) else p.duration_ticks
                rows.append(struct.pack(">IIIi", step, len(payloads[t.track_id][i]), 0x02000000 if p.key else 0x01010000, p.ticks - d[i]))
            run = _full(b"trun", struct.pack(">Ii", len(rows), at), *rows, version=1, flags=0xF01)
            trafs.append(_box(b"traf", _full(b"tfhd", struct.pack(">I", t.track_id), flags=0x20000), _full(b"tfdt", struct.pack(">Q", d[first]), version=1), run))
            at += sum(len(payloads[t.track_id][i]) for i in range(first, last))
        return _box(b"moof", _full(b"mfhd", struct.pack(">I", number)), *trafs)

    body = b"".join(payloads[t.track_id][i] for t in tracks for i in range(*parts.get(t.track_id, (0, 0))))
    return moof(len(moof(0))) + _box(b"mdat", body)


def fragments(tracks: list[Track], payloads: dict[int, list[bytes]], seconds: float = 1.0) -> list[bytes]:
    """All packets as fragments of at least so long, which begin with a key packet of the first video track (or of any track, without video)."""
    dts = {t.track_id: decode_ticks(t.packets) for t in tracks}
    lead = next((t for t in tracks if t.type == "video" and t.packets), next((t for t in tracks if t.packets), None))
    if lead is None:
        return []
    cuts: list[float] = []
    for p, d in zip(lead.packets, dts[lead.track_id], strict=True):
        if p.key and (not cuts or d / lead.resolution - cuts[-1] >= seconds - 1e-9):
            cuts.append(d / lead.resolution)
    out, places = [], dict.fromkeys(dts, 0)
    for k in range(len(cuts)):
        parts = {}
        for t in tracks:
            first = last = places[t.track_id]
            while last < len(t.packets) and (k + 1 == len(cuts) or dts[t.track_id][last] / t.resolution < cuts[k + 1] - 1e-9):
                last += 1
            parts[t.track_id], places[t.track_id] = (first, last), last
        out.append(fragment(k + 1, tracks, payloads, parts, dts))
    return out


def build_fragmented(tracks: list[Track], payloads: dict[int, list[bytes]], tags: dict[str, str] | None = None, seconds: float = 1.0) -> bytes:
    """A fragmented MP4 file."""
    return initialisation(tracks, tags) + b"".join(fragments(tracks, payloads, seconds))


def with_initialisation(init: bytes, segment: bytes) -> Media:
    """A segment that has no header of its own, read with that of another file."""
    moov, brand = find(init, 0, len(init), b"moov"), find(init, 0, len(init), b"ftyp")
    if not moov:
        raise MediaError("no moov box")
    head = (init[brand[0] - 8 : brand[1]] if brand else b"") + init[moov[0] - 8 : moov[1]]
    found = parse(head + segment)
    for t in found.tracks:
        for p in t.packets:
            p.offset -= len(head)
    return found


def size_bound(tracks: list[Track]) -> int:
    """At most so many bytes a file's header takes: what tables need at worst, a row for each packet, and a fixed part for each track."""
    return 1024 + sum(2048 + len(t.description or b"") + 40 * len(t.packets) for t in tracks)


def protection(data: bytes) -> list[dict]:
    """The protection boxes (pssh) of a file: system, key ids and data in hexadecimal."""
    moov = find(data, 0, len(data), b"moov")
    places = [p for p in [moov, *((a, b) for n, a, b in boxes(data, 0, len(data)) if n == b"moof")] if p]
    return [parse_protection(data[a:b]) for p in places for n, a, b in boxes(data, *p) if n == b"pssh"]


def parse_protection(body: bytes) -> dict:
    """The contents of a pssh box."""
    if len(body) < 24:
        raise MediaError("a protection box is too short")
    version, system, at, keys = body[0], body[4:20].hex(), 20, []
    if version:
        (n,) = _take(">I", body, at)
        keys, at = [body[at + 4 + 16 * i : at + 20 + 16 * i].hex() for i in range(n)], at + 4 + 16 * n
    (size,) = _take(">I", body, at)
    if len(body) < at + 4 + size:
        raise MediaError("a protection box ends early")
    return {"version": version, "system_id": system, "key_ids": keys, "data": body[at + 4 : at + 4 + size].hex()}


def build_protection(system_id: str, key_ids: list[str], data: bytes) -> bytes:
    """A pssh box."""
    keys = struct.pack(">I", len(key_ids)) + b"".join(map(bytes.fromhex, key_ids)) if key_ids else b""
    return _full(b"pssh", bytes.fromhex(system_id), keys, struct.pack(">I", len(data)), data, version=1 if key_ids else 0)

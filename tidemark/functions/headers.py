"""Headers of coded streams, after their standards: AC-3, E-AC-3 and DTS frames, Vorbis modes, HEVC parameter sets, AV1 sequences. Plain Python."""

from __future__ import annotations

import struct

from ..sources.model import Bits, MediaError
from .bitstream import av1_units, unescape

#: kbit/s by half of an AC-3 frame's size code; sampling rates; channels by coding mode.
AC3_KBITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_RATES = (48000, 44100, 32000)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)
EAC3_BLOCKS = (1, 2, 3, 6)
#: DTS channels by arrangement, sampling rates and bit rates by code (None: not allowed, or open).
DTS_CHANNELS = (1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 6, 6, 6, 7, 8, 8)
DTS_RATES = (None, 8000, 16000, 32000, None, None, 11025, 22050, 44100, None, None, 12000, 24000, 48000, None, None)
DTS_KBITS = (32, 56, 64, 96, 112, 128, 192, 224, 256, 320, 384, 448, 512, 576, 640, 768, 960, 1024, 1152, 1280, 1344, 1408, 1411.2, 1472, 1536, 1920, 2048, 3072, 3840, None, None, None)
#: HEVC unit types of parameter sets.
VPS, SPS, PPS = 32, 33, 34


def ac3_frame(data: bytes) -> dict | None:
    """Size, rate, channels, samples and codec details of the AC-3 frame at the start, or None."""
    if len(data) < 7 or data[:2] != b"\x0b\x77":
        return None
    b = Bits(data, 4)
    rate_code, size_code, stream_id, mode_id, coding = b.read(2), b.read(6), b.read(5), b.read(3), b.read(3)
    if rate_code == 3 or size_code // 2 >= len(AC3_KBITS) or stream_id > 10:
        return None
    if coding & 1 and coding != 1:
        b.skip(2)  # centre mix
    if coding & 4:
        b.skip(2)  # surround mix
    if coding == 2:
        b.skip(2)  # Dolby surround
    low = b.read(1)
    kbits = AC3_KBITS[size_code // 2]
    words = {0: 2 * kbits, 1: 320 * kbits // 147 + (size_code & 1), 2: 3 * kbits}[rate_code]
    return {"size": 2 * words, "rate": AC3_RATES[rate_code], "channels": AC3_CHANNELS[coding] + low, "samples": 1536, "bitrate": 1000 * kbits, "bsid": stream_id, "bsmod": mode_id, "acmod": coding, "lfe": bool(low), "rate_code": rate_code, "size_code": size_code}


def eac3_frame(data: bytes) -> dict | None:
    """The same of an E-AC-3 frame; ``stream`` and ``substream`` tell independent frames (0) from dependent ones (1)."""
    if len(data) < 6 or data[:2] != b"\x0b\x77":
        return None
    b = Bits(data, 2)
    stream, substream, size, rate_code = b.read(2), b.read(3), 2 * (b.read(11) + 1), b.read(2)
    if stream == 3:
        return None
    if rate_code == 3:
        half = b.read(2)
        if half == 3:
            return None
        rate, blocks = AC3_RATES[half] // 2, 6
    else:
        rate, blocks = AC3_RATES[rate_code], EAC3_BLOCKS[b.read(2)]
    coding, low, stream_id = b.read(3), b.read(1), b.read(5)
    if not 10 < stream_id <= 16:
        return None
    samples = 256 * blocks
    return {"size": size, "rate": rate, "channels": AC3_CHANNELS[coding] + low, "samples": samples, "bitrate": 8 * size * rate // samples, "bsid": stream_id, "acmod": coding, "lfe": bool(low), "stream": stream, "substream": substream}


def dts_frame(data: bytes) -> dict | None:
    """The same of the core frame of DTS; a bit rate that its size can't hold is left out."""
    if len(data) < 12 or data[:4] != b"\x7f\xfe\x80\x01":
        return None
    b = Bits(data, 4)
    normal, short, checked = b.read(1), b.read(5), b.read(1)
    blocks, size, arrangement, rate_code, kbits_code = b.read(7) + 1, b.read(14) + 1, b.read(6), b.read(4), b.read(5)
    b.skip(1 + 1 + 1 + 1 + 1 + 3 + 1 + 1)
    low = b.read(2)
    rate = DTS_RATES[rate_code]
    if blocks < 6 or size < 96 or rate is None or (normal and short != 31) or low == 3:
        return None
    channels = DTS_CHANNELS[arrangement] if arrangement < len(DTS_CHANNELS) else None
    kbits = DTS_KBITS[kbits_code]
    fits = kbits is not None and 8 * size * rate <= 1.01 * 1000 * kbits * 32 * blocks
    return {"size": size, "rate": rate, "channels": None if channels is None else channels + bool(low), "samples": 32 * blocks, "bitrate": round(1000 * kbits) if fits else None, "lfe": bool(low), "checked": bool(checked)}


def vorbis_modes(setup: bytes) -> list[bool]:
    """Which modes of a Vorbis stream use long blocks. The setup ends with them, so it is read from its end.

    A mode is a block flag, a window and a transform (16 bits of 0 each) and a
    mapping of 8 bits; six bits before the first tell how many there are, less one.
    """
    bits = [(byte >> i) & 1 for byte in setup for i in range(8)]  # the least significant bit comes first
    end = len(bits)
    while end and not bits[end - 1]:
        end -= 1
    end -= 1  # the framing bit
    number = lambda at, n: sum(bits[at + i] << i for i in range(n))
    found: list[bool] = []
    best: list[bool] | None = None
    while end >= 41 + 6 and len(found) < 64 and number(end - 40, 32) == 0 and number(end - 8, 8) < 64:
        end -= 41
        found.insert(0, bool(bits[end]))
        if number(end - 6, 6) == len(found) - 1:
            best = list(found)
    if best is None:
        raise MediaError("no modes in the Vorbis setup")
    return best


def vorbis_durations(packets: list[bytes], modes: list[bool], short: int, long: int) -> list[int]:
    """Samples that each audio packet adds: a quarter of the block before it and a quarter of its own; the first adds none."""
    width = max(1, (len(modes) - 1).bit_length())
    out, before = [], 0
    for p in packets:
        mode = (p[0] >> 1) & ((1 << width) - 1) if p and not p[0] & 1 and len(modes) > 1 else 0
        block = long if modes[min(mode, len(modes) - 1)] else short
        out.append((before + block) // 4 if before else 0)
        before = block
    return out


def hevc_sps(unit: bytes) -> dict:
    """Profile, level, size and depth of a sequence parameter set (with its two header bytes)."""
    b = Bits(unescape(unit), 2)
    b.skip(4)
    layers, nested = b.read(3), b.read(1)
    space, tier, profile, compatible, constraints, level = b.read(2), b.read(1), b.read(5), b.read(32), b.read(48), b.read(8)
    present = [(b.read(1), b.read(1)) for _ in range(layers)]
    if layers:
        b.skip(2 * (8 - layers))
    for has_profile, has_level in present:
        b.skip(88 * has_profile + 8 * has_level)
    b.exp_golomb()
    chroma = b.exp_golomb()
    separate = b.read(1) if chroma == 3 else 0
    width, height = b.exp_golomb(), b.exp_golomb()
    left = right = top = bottom = 0
    if b.read(1):
        left, right, top, bottom = (b.exp_golomb() for _ in range(4))
    across, down = (2 if chroma in (1, 2) and not separate else 1), (2 if chroma == 1 and not separate else 1)
    depth, chroma_depth = 8 + b.exp_golomb(), 8 + b.exp_golomb()
    return {
        "profile_space": space, "tier": tier, "profile": profile, "compatible": compatible, "constraints": constraints.to_bytes(6, "big"), "level": level, "layers": layers + 1, "nested": nested, "chroma": chroma, "depth": depth, "chroma_depth": chroma_depth,
        "coded_width": width, "coded_height": height, "width": width - across * (left + right), "height": height - down * (top + bottom),
    }


def hevc_codec_string(sps: dict, kind: str = "hvc1") -> str:
    """hvc1.space profile.compatibility.tier level.constraints: the compatibility bits in reverse, constraint bytes without the zeros at the end."""
    turned = int(f"{sps['compatible']:032b}"[::-1], 2)
    tail = "".join(f".{x:X}" for x in sps["constraints"].rstrip(b"\0"))
    return f"{kind}.{('', 'A', 'B', 'C')[sps['profile_space']]}{sps['profile']}.{turned:X}.{'LH'[sps['tier']]}{sps['level']}{tail}"


def hevc_configuration(units: list[bytes]) -> bytes | None:
    """A decoder configuration record of the parameter sets among these units, or None without a sequence's."""
    sets = {k: [u for u in units if len(u) > 2 and (u[0] >> 1) & 63 == k] for k in (VPS, SPS, PPS)}
    if not sets[SPS]:
        return None
    s = hevc_sps(sets[SPS][0])
    head = struct.pack(">BBI6sBHBBBBHB", 1, s["profile_space"] << 6 | s["tier"] << 5 | s["profile"], s["compatible"], s["constraints"], s["level"], 0xF000, 0xFC, 0xFC | s["chroma"], 0xF8 | (s["depth"] - 8), 0xF8 | (s["chroma_depth"] - 8), 0, s["layers"] << 3 | s["nested"] << 2 | 3)
    arrays = [struct.pack(">BH", 0x80 | k, len(us)) + b"".join(struct.pack(">H", len(u)) + u for u in us) for k, us in sets.items() if us]
    return head + bytes([len(arrays)]) + b"".join(arrays)


def parse_hevc_configuration(data: bytes) -> dict:
    """What a decoder configuration record says, and its units by type."""
    if len(data) < 23 or data[0] != 1:
        raise MediaError("no HEVC configuration")
    _, first, compatible, constraints, level, _, _, chroma, depth, chroma_depth, _, last, arrays = struct.unpack_from(">BBI6sBHBBBBHBB", data)
    at, sets = 23, {}
    for _ in range(arrays):
        kind, n = data[at] & 63, struct.unpack_from(">H", data, at + 1)[0]
        at += 3
        for _ in range(n):
            (size,) = struct.unpack_from(">H", data, at)
            sets.setdefault(kind, []).append(data[at + 2 : at + 2 + size])
            at += 2 + size
    return {
        "profile_space": first >> 6, "tier": first >> 5 & 1, "profile": first & 31, "compatible": compatible, "constraints": constraints, "level": level, "chroma": chroma & 3, "depth": 8 + (depth & 7), "chroma_depth": 8 + (chroma_depth & 7), "length_size": (last & 3) + 1, "units": sets
    }


def av1_sequence(packet: bytes) -> dict | None:
    """Profile, level, tier, depth and size of the sequence header in a packet, or None."""
    body = next((body for kind, body in av1_units(packet) if kind == 1), None)
    if body is None:
        return None
    b = Bits(body)
    profile, _, reduced = b.read(3), b.read(1), b.read(1)
    tier = 0
    if reduced:
        level = b.read(5)
    else:
        model = delay_bits = 0
        if b.read(1):
            b.skip(64)
            if b.read(1):
                b.exp_golomb()
            model = b.read(1)
            if model:
                delay_bits = b.read(5) + 1
                b.skip(32 + 5 + 5)
        delays, points = b.read(1), b.read(5) + 1
        level = 0
        for i in range(points):
            b.skip(12)
            seen = b.read(5)
            seen_tier = b.read(1) if seen > 7 else 0
            if i == 0:
                level, tier = seen, seen_tier
            if model and b.read(1):
                b.skip(2 * delay_bits + 1)
            if delays and b.read(1):
                b.skip(4)
    wide, high = b.read(4) + 1, b.read(4) + 1
    width, height = b.read(wide) + 1, b.read(high) + 1
    if not reduced and b.read(1):
        b.skip(7)
    b.skip(3)
    if not reduced:
        b.skip(4)
        hint = b.read(1)
        if hint:
            b.skip(2)
        screen = 2 if b.read(1) else b.read(1)
        if screen and not b.read(1):
            b.skip(1)
        if hint:
            b.skip(3)
    b.skip(3)
    deep = b.read(1)
    depth = (12 if b.read(1) else 10) if profile == 2 and deep else 10 if deep else 8
    mono = 0 if profile == 1 else b.read(1)
    return {"profile": profile, "level": level, "tier": tier, "depth": depth, "mono": bool(mono), "width": width, "height": height}


def av1_codec_string(sequence: dict) -> str:
    return f"av01.{sequence['profile']}.{sequence['level']:02d}{'MH'[sequence['tier']]}.{sequence['depth']:02d}"


def vp9_codec_string(profile: int, level: int, depth: int) -> str:
    return f"vp09.{profile:02d}.{level:02d}.{depth:02d}"


#: Codec strings that don't depend on the stream.
PLAIN_STRINGS = {"vp8": "vp8", "opus": "opus", "vorbis": "vorbis", "mp3": "mp3", "flac": "flac", "ac3": "ac-3", "eac3": "ec-3", "dts": "dtsc"}


def audio_codec_string(codec: str, object_type: int = 2) -> str:
    """The codec string of an audio track: AAC tells its object type, PCM is its own name."""
    return f"mp4a.40.{object_type}" if codec == "aac" else PLAIN_STRINGS.get(codec, codec)

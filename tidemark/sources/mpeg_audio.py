"""MP3 and ADTS streams: frames after an optional ID3 tag."""

from __future__ import annotations

from .model import Bits, Media, MediaError, Packet, Track
from .tags import id3v1, id3v2, id3v2_size

#: Kilobits a second by (low sampling rate, layer), sampling rates by version, AAC sampling rates.
BITRATES = {
    (False, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def mp3_header(data: bytes, at: int) -> dict | None:
    """Fields of the frame header at this place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer_bits = (data[at + 1] >> 3) & 3, (data[at + 1] >> 1) & 3
    bit_index, rate_index, padding = data[at + 2] >> 4, (data[at + 2] >> 2) & 3, (data[at + 2] >> 1) & 1
    if version == 1 or not layer_bits or rate_index == 3 or bit_index in (0, 15):
        return None
    layer, low = 4 - layer_bits, version != 3
    rate, bitrate = RATES[version][rate_index], BITRATES[low, layer][bit_index] * 1000
    samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
    size = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    return {"layer": layer, "rate": rate, "bitrate": bitrate, "samples": samples, "size": size, "channels": 1 if data[at + 3] >> 6 == 3 else 2, "low": low}


#: Bytes after the tag in which the first frame is looked for.
SEARCHED = 4096


def is_mp3(data: bytes) -> bool:
    """Whether a frame that another one follows, or that ends the data, begins soon after the tag. A first frame elsewhere than there needs a follower."""
    begin = id3v2_size(data)
    for at in range(begin, min(begin + SEARCHED, len(data) - 3)):
        h = mp3_header(data, at)
        if h is not None and h["layer"] == 3:
            follows = at + h["size"] < len(data) - 3
            if (follows and mp3_header(data, at + h["size"]) is not None) or (at == begin and not follows):
                return True
    return False


def xing_frames(frame: bytes, h: dict) -> int | None:
    """How many frames a first frame of the Xing kind says there are; None for another frame, 0 if it doesn't say."""
    side = (9 if h["channels"] == 1 else 17) if h["low"] else (17 if h["channels"] == 1 else 32)
    if frame[4 + side : 8 + side] not in (b"Xing", b"Info"):
        return None
    return int.from_bytes(frame[12 + side : 16 + side], "big") if frame[11 + side] & 1 else 0


def parse_mp3(data: bytes) -> Media:
    at, end = id3v2_size(data), len(data)
    tags = {**id3v1(data), **id3v2(data)}
    if data[-128:-125] == b"TAG":
        end -= 128
    track, ticks = None, 0
    while at < end:
        h = mp3_header(data, at)
        if h is None or at + h["size"] > end:
            at += 1
            continue
        if track is None:
            track = Track(1, "audio", "mp3", float(h["rate"]), channels=h["channels"], sample_rate=h["rate"], codec_string="mp3")
            told = xing_frames(data[at : at + h["size"]], h)
            if told is not None:
                track.duration_ticks = told * h["samples"] or None
                at += h["size"]
                continue
        track.packets.append(Packet(len(track.packets), ticks, h["samples"], at, h["size"]))
        ticks += h["samples"]
        at += h["size"]
    if track is None:
        raise MediaError("no MP3 frame")
    track.duration_ticks = track.duration_ticks or ticks
    return Media("mp3", [track], tags)


def adts_header(data: bytes, at: int) -> dict | None:
    if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
        return None
    b = Bits(data, at)
    b.skip(15)
    no_crc, profile, rate_index = b.read(1), b.read(2), b.read(4)
    b.skip(1)
    channels = b.read(3)
    b.skip(4)
    size = b.read(13)
    head = 7 if no_crc else 9
    if rate_index >= len(AAC_RATES) or size < head:
        return None
    return {"object_type": profile + 1, "rate": AAC_RATES[rate_index], "rate_index": rate_index, "channels": 8 if channels == 7 else channels, "size": size, "head": head}


def is_adts(data: bytes) -> bool:
    at = id3v2_size(data)
    h = adts_header(data, at)
    return h is not None and (at + h["size"] >= len(data) or adts_header(data, at + h["size"]) is not None)


def audio_specific_config(object_type: int, rate: int, channels: int) -> bytes:
    """The decoder description of an AAC track."""
    value, bits = 0, 0
    wide = [(object_type, 5)] if object_type < 31 else [(31, 5), (object_type - 32, 6)]
    wide += [(AAC_RATES.index(rate), 4)] if rate in AAC_RATES else [(15, 4), (rate, 24)]
    for v, n in [*wide, (7 if channels == 8 else channels, 4)]:
        value, bits = value << n | v, bits + n
    size = -(-bits // 8)
    return (value << (size * 8 - bits)).to_bytes(size, "big")


def parse_audio_specific_config(data: bytes) -> dict:
    b = Bits(data)
    kind = b.read(5)
    kind = 32 + b.read(6) if kind == 31 else kind
    index = b.read(4)
    rate = b.read(24) if index == 15 else AAC_RATES[index] if index < len(AAC_RATES) else None
    channels = b.read(4)
    return {"object_type": kind, "rate": rate, "channels": 8 if channels == 7 else channels}


def parse_adts(data: bytes) -> Media:
    at, track = id3v2_size(data), None
    tags = id3v2(data)
    while h := adts_header(data, at):
        if at + h["size"] > len(data):
            break
        if track is None:
            track = Track(1, "audio", "aac", float(h["rate"]), channels=h["channels"], sample_rate=h["rate"], codec_string=f"mp4a.40.{h['object_type']}", description=audio_specific_config(h["object_type"], h["rate"], h["channels"]))
        n = len(track.packets)
        track.packets.append(Packet(n, n * 1024, 1024, at + h["head"], h["size"] - h["head"]))
        at += h["size"]
    if track is None:
        raise MediaError("no ADTS frame")
    track.duration_ticks = 1024 * len(track.packets)
    return Media("adts", [track], tags)


def build_adts(packets: list[bytes], description: bytes) -> bytes:
    """AAC packets with a header each."""
    c = parse_audio_specific_config(description)
    out = bytearray()
    for p in packets:
        size = len(p) + 7
        fields = ((0xFFF, 12), (0, 1), (0, 2), (1, 1), (c["object_type"] - 1, 2), (AAC_RATES.index(c["rate"]), 4), (0, 1), (7 if c["channels"] == 8 else c["channels"], 3), (0, 4), (size, 13), (0x7FF, 11), (0, 2))
        value = 0
        for v, n in fields:
            value = value << n | v
        out += value.to_bytes(7, "big") + p
    return bytes(out)

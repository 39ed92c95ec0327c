"""Headers of coded streams, written bit by bit here and read by the library."""

import pytest

from tidemark.functions import headers as hd
from tidemark.functions.bitstream import to_annex_b
from tidemark.sources.model import MediaError


def bits(*fields):
    """(value, width) from the most significant bit on; "ue" as a width is an exponential Golomb code."""
    text = ""
    for value, width in fields:
        if width == "ue":
            digits = bin(value + 1)[2:]
            text += "0" * (len(digits) - 1) + digits
        else:
            text += f"{value:0{width}b}"
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize(("rate", "code", "size"), [(0, 0, 128), (0, 37, 2560), (1, 8, 278), (1, 9, 280), (2, 20, 1152), (1, 29, 1672)])
def test_ac3_sizes(rate, code, size):
    f = hd.ac3_frame(b"\x0b\x77\0\0" + bits((rate, 2), (code, 6), (8, 5), (0, 3), (7, 3), (1, 2), (1, 2), (1, 1)) + bytes(4))
    assert (f["size"], f["rate"], f["channels"], f["samples"]) == (size, hd.AC3_RATES[rate], 6, 1536)


def test_ac3_modes_and_what_is_none():
    stereo = b"\x0b\x77\0\0" + bits((0, 2), (20, 6), (8, 5), (0, 3), (2, 3), (3, 2), (1, 1)) + bytes(4)
    assert hd.ac3_frame(stereo)["channels"] == 3 and hd.ac3_frame(stereo[:5]) is None and hd.ac3_frame(b"\0" + stereo) is None
    assert hd.ac3_frame(b"\x0b\x77\0\0" + bits((3, 2), (20, 6), (8, 5), (0, 3), (2, 3)) + bytes(4)) is None


def test_eac3():
    f = hd.eac3_frame(b"\x0b\x77" + bits((0, 2), (3, 3), (383, 11), (0, 2), (3, 2), (7, 3), (1, 1), (16, 5)))
    assert (f["size"], f["rate"], f["channels"], f["samples"], f["bitrate"], f["substream"]) == (768, 48000, 6, 1536, 192000, 3)
    half = hd.eac3_frame(b"\x0b\x77" + bits((1, 2), (0, 3), (99, 11), (3, 2), (1, 2), (2, 3), (0, 1), (16, 5)))
    assert (half["rate"], half["samples"], half["stream"]) == (22050, 1536, 1)
    assert hd.eac3_frame(b"\x0b\x77" + bits((0, 2), (0, 3), (99, 11), (0, 2), (0, 2), (2, 3), (0, 1), (8, 5))) is None


def test_dts():
    def frame(blocks=15, size=1005, arrangement=9, rate=13, kbits=15, low=2):
        return b"\x7f\xfe\x80\x01" + bits((1, 1), (31, 5), (0, 1), (blocks, 7), (size, 14), (arrangement, 6), (rate, 4), (kbits, 5), (0, 10), (low, 2)) + bytes(4)

    f = hd.dts_frame(frame())
    assert (f["size"], f["rate"], f["channels"], f["samples"], f["bitrate"]) == (1006, 48000, 6, 512, 768000)
    assert hd.dts_frame(frame(kbits=0))["bitrate"] is None and hd.dts_frame(frame(rate=0)) is None and hd.dts_frame(frame(blocks=3)) is None


def vorbis_setup(flags):
    fields = [(0x5A, 8)] * 3 + [(len(flags) - 1, 6)]
    for k, f in enumerate(flags):
        fields += [(int(f), 1), (0, 16), (0, 16), (k, 8)]
    text = "".join(f"{v:0{n}b}"[::-1] for v, n in [*fields, (1, 1)])
    text += "0" * (-len(text) % 8)
    return b"\5vorbis" + bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))


@pytest.mark.parametrize("flags", [[False], [False, True], [True, False, True]])
def test_vorbis_modes(flags):
    assert hd.vorbis_modes(vorbis_setup(flags)) == flags
    with pytest.raises(MediaError):
        hd.vorbis_modes(b"\5vorbis\1")


def test_vorbis_durations():
    modes = [False, True]
    packets = [bytes([mode << 1]) for mode in (1, 1, 0, 0, 1)]
    assert hd.vorbis_durations(packets, modes, 256, 2048) == [0, 1024, 576, 128, 576]


def hevc_unit(width=1920, height=1088, crop=4, depth=8, layers=0):
    fields = [(0x4201, 16), (0, 4), (layers, 3), (1, 1), (0, 2), (0, 1), (1, 5), (0x60000000, 32), (0xB0, 8), (0, 40), (93, 8)]
    fields += [(1, 1), (1, 1)] * layers + ([(0, 2 * (8 - layers))] if layers else []) + [(0, 96)] * layers
    fields += [(0, "ue"), (1, "ue"), (width, "ue"), (height, "ue"), (1, 1), (0, "ue"), (0, "ue"), (0, "ue"), (crop, "ue"), (depth - 8, "ue"), (depth - 8, "ue"), (4, "ue"), (1, 1)]
    raw, out = bits(*fields), bytearray()
    for x in raw:  # escapes, as the standard has them
        if x <= 3 and out[-2:] == b"\0\0":
            out.append(3)
        out.append(x)
    return bytes(out)


@pytest.mark.parametrize("layers", [0, 2])
def test_hevc(layers):
    unit = hevc_unit(layers=layers, depth=10)
    s = hd.hevc_sps(unit)
    assert (s["width"], s["height"], s["depth"], s["level"], s["layers"]) == (1920, 1080, 10, 93, layers + 1)
    assert hd.hevc_codec_string(s) == "hvc1.1.6.L93.B0"
    vps, pps = b"\x40\x01\x0c", b"\x44\x01\xc1"
    record = hd.hevc_configuration([vps, unit, pps, b"\x26\x01rest"])
    found = hd.parse_hevc_configuration(record)
    assert found["units"] == {32: [vps], 33: [unit], 34: [pps]} and (found["level"], found["depth"], found["length_size"]) == (93, 10, 4)
    assert hd.hevc_configuration([vps]) is None and to_annex_b([unit])
    with pytest.raises(MediaError):
        hd.parse_hevc_configuration(b"\0" * 30)


@pytest.mark.parametrize(("profile", "level", "deep"), [(0, 8, 0), (0, 13, 1), (2, 5, 1)])
def test_av1(profile, level, deep):
    fields = [(profile, 3), (0, 1), (0, 1), (0, 1), (0, 1), (0, 5), (0, 12), (level, 5)] + ([(1, 1)] if level > 7 else [])
    fields += [(10, 4), (10, 4), (1279, 11), (719, 11), (0, 1), (0, 3), (0, 4), (1, 1), (0, 2), (1, 1), (1, 1), (0, 3), (0, 3), (deep, 1)]
    fields += ([(0, 1)] if profile == 2 and deep else []) + [(0, 1), (0, 8)]
    body = bits(*fields)
    s = hd.av1_sequence(bytes([0x12, 0]) + bytes([0x0A, len(body)]) + body)
    assert (s["width"], s["height"], s["depth"]) == (1280, 720, 10 if deep else 8)
    assert hd.av1_codec_string(s) == f"av01.{profile}.{level:02d}{'H' if level > 7 else 'M'}.{10 if deep else 8:02d}"
    assert hd.av1_sequence(bytes([0x12, 0])) is None


def test_plain_strings():
    assert hd.audio_codec_string("aac", 5) == "mp4a.40.5" and hd.audio_codec_string("ac3") == "ac-3" and hd.audio_codec_string("pcm-s16") == "pcm-s16" and hd.vp9_codec_string(0, 31, 8) == "vp09.00.31.08"

"""Bitstreams, rates of a quality, and decoders."""

import io
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import bitstream as bs
from tidemark.functions import coders, encoding
from tidemark.sources import media


def bits(*fields):
    """Fields as (value, width), or a number for an Exp-Golomb code."""
    out = ""
    for f in fields:
        out += format(f[0], f"0{f[1]}b") if isinstance(f, tuple) else "0" * ((f + 1).bit_length() - 1) + format(f + 1, "b")
    out += "1"
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def sps(width_mbs=20, height_mbs=15, crop=(0, 0, 0, 0), profile=66):
    extra = (1, 0, 0, (0, 1), (0, 1)) if profile == 100 else ()
    return b"\x67" + bits((profile, 8), (0xC0, 8), (30, 8), 0, *extra, 0, 0, 2, 1, (0, 1), width_mbs - 1, height_mbs - 1, (1, 1), (1, 1), (1, 1) if any(crop) else (0, 1), *(crop if any(crop) else ()), (0, 1))


@pytest.mark.parametrize("profile", [66, 100])
def test_avc_parameter_set(profile):
    s = bs.avc_sps(sps(profile=profile, height_mbs=68, width_mbs=120, crop=(0, 0, 0, 4)))
    assert (s["width"], s["height"], s["codec_string"]) == (1920, 1080, f"avc1.{profile:02x}c01e")


def test_units_and_configuration():
    units = [sps(), b"\x68\xce\x38\x80", b"\x65" + bytes([1, 2, 3, 0, 0, 3, 1])]
    assert list(bs.annex_b_units(bs.to_annex_b(units))) == units and list(bs.prefixed_units(bs.to_prefixed(units, 2), 2)) == units
    assert bs.unescape(b"\0\0\3\1\0\0\3\0") == b"\0\0\1\0\0\0"
    c = bs.parse_avc_configuration(bs.avc_configuration(units))
    assert c["sps"] == units[:1] and c["pps"] == units[1:2] and c["length_size"] == 4
    assert bs.avc_configuration(units[2:]) is None and list(bs.prefixed_units(b"\0\0\0\x09abc")) == []


def test_packet_types(spark):
    assert bs.packet_type("avc", bs.to_annex_b([b"\x65x"])) == "key" and bs.packet_type("avc", bs.to_annex_b([b"\x41x"])) == "delta" and bs.packet_type("avc", bs.to_annex_b([b"\x09x"])) is None
    assert bs.packet_type("hevc", bs.to_prefixed([bytes([19 << 1, 1, 9])]), 4) == "key" and bs.packet_type("hevc", bs.to_annex_b([bytes([2, 1])])) == "delta"
    assert bs.packet_type("vp8", b"\x10") == "key" and bs.packet_type("vp8", b"\x11") == "delta" and bs.packet_type("vp8", b"") is None
    key = bits((2, 2), (0, 1), (0, 1), (0, 1), (0, 1), (0, 2), (0x498342, 24), (1, 3), (0, 1), (639, 16), (479, 16))
    assert bs.vp9_header(key) == {"profile": 0, "key": True, "bit_depth": 8, "width": 640, "height": 480} and bs.packet_type("vp9", bits((2, 2), (0, 2), (0, 1), (1, 1), (0, 2))) == "delta"
    assert bs.packet_type("av1", bytes([0x12, 0, 0x32, 2, 0x10, 0])) == "key" and bs.packet_type("av1", bytes([0x32, 1, 0x30])) == "delta"
    rows = spark.createDataFrame([("vp8", bytearray(b"\x10")), ("vp8", None)], "codec string, data binary").select(bs.determine_type("codec", "data").alias("t")).collect()
    assert [r["t"] for r in rows] == ["key", None]


def test_geometry(spark):
    df = spark.range(1)
    lit = F.lit
    r = df.select(bs.pixel_aspect_ratio(lit(1024), lit(576), lit(720), lit(576)).alias("p"), bs.clamp_crop(lit(10), lit(0), lit(100), lit(50), lit(64), lit(48)).alias("c"), bs.fit_rectangle("contain", lit(200), lit(100), lit(100), lit(100)).alias("a"), bs.fit_rectangle("cover", lit(200), lit(100), lit(100), lit(100)).alias("b"), bs.rotate(lit(270), lit(180)).alias("r"), bs.almost_integer(lit(3.0000000000000004)).alias("n"), bs.almost_integer(lit(3.1)).alias("m")).first()
    assert tuple(r["p"]) == (64, 45) and tuple(r["c"]) == (10, 0, 54, 48) and tuple(r["a"]) == (0, 25, 100, 50) and tuple(r["b"]) == (-50, 0, 200, 100)
    assert (r["r"], r["n"], r["m"]) == (90, 3.0, 3.1)
    assert bs.rational_approximation(math.pi, 120) == (355, 113) and bs.rational_approximation(0.5, 10) == (1, 2) and bs.simplest(6, 4) == (3, 2)


def test_rates_of_a_quality(spark):
    q = spark.createDataFrame([("avc", "medium"), ("hevc", "high"), ("vp8", "very-low"), ("nope", "low")], "codec string, q string").withColumn("n", encoding.level(F.col("q")))
    rows = q.select("codec", "n", encoding.video_bitrate(F.col("codec"), F.lit(1280), F.lit(720), F.col("n")).alias("b"), encoding.quantiser(F.col("codec"), F.col("n")).alias("z")).collect()
    for r in rows[:3]:
        want = math.ceil(3e6 * (1280 * 720 / (1920 * 1080)) ** 0.95 * encoding.EFFICIENCY[r["codec"]] * 0.3 * math.exp(2.5538 * r["n"]) / 1000) * 1000
        assert r["b"] == want
    assert rows[3]["b"] is None and [r["z"] for r in rows] == [29, 22, None, None]
    a = spark.createDataFrame([("aac", 0.5), ("mp3", 0.0), ("opus", 0.0), ("flac", 1.0), ("ac3", 1.0)], "c string, q double").select(encoding.audio_bitrate(F.col("c"), F.col("q")).alias("b")).collect()
    assert [r["b"] for r in a] == [128000, 48000, 19000, None, round(384000 * 0.3 * math.exp(2.5538) / 1000) * 1000]
    s = spark.createDataFrame([("avc1.640028",), ("mp4a.40.2",), ("mp4a.6B",), ("av01.0",), ("pcm-s16",), ("what",)], "s string").select(encoding.codec_of(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in s] == ["avc", "aac", "mp3", "av1", "pcm-s16", None]


def test_decoding_a_wave_file(spark, tmp_path):
    x = (np.sin(np.arange(9000) / 30) * 20000).astype("<i2")
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(48000)
        w.writeframes(x.tobytes())
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    files = media.files(spark, str(tmp_path))
    p = media.packets(files).join(media.tracks(files).select("file_id", "track_id", "codec", "channels", "sample_rate"), ["file_id", "track_id"])
    rows = coders.decode_audio(p, coders.Registry()).orderBy("seq").collect()
    assert [r["frames"] for r in rows] == [2048, 2048, 404]
    assert np.allclose(np.concatenate([r["samples"] for r in rows]), x / 32768.0, atol=1e-6)
    with pytest.raises(Exception, match="no decoder"):
        coders.decode_audio(p.withColumn("codec", F.lit("aac")), coders.Registry()).collect()


def test_registry_and_pcm():
    r = coders.Registry()
    assert r.can_decode("pcm-s24be") and not r.can_decode("opus")
    r.register("opus", lambda data, channels: np.zeros(960 * channels))
    assert r.can_decode("opus") and "opus" in r.decodable()
    assert coders.pcm("pcm-s24")(b"\0\0\x40", 1).tolist() == [0.5] and coders.pcm("pcm-s24be")(b"\xc0\0\0", 1).tolist() == [-0.5]
    assert coders.pcm("pcm-u8")(bytes([0, 128, 255]), 1).tolist() == [-1.0, 0.0, 127 / 128] and coders.pcm("pcm-f32be")(struct.pack(">f", 0.25), 1).tolist() == [0.25]

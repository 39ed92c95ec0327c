"""Registered coders: PCM both ways, and toy video coders with state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import coders, pixels


@pytest.mark.parametrize("codec", coders.PCM)
def test_pcm_both_ways(codec):
    x = np.linspace(-0.99, 0.99, 64)
    back = coders.pcm(codec)(coders.pcm_encoder(codec)(x, 1), 1)
    if codec in ("ulaw", "alaw"):
        assert len(back) == 64 and np.sign(back[0]) == -1 and (np.diff(back) >= 0).all()
    else:
        assert np.abs(back - x).max() < (0.02 if "8" in codec else 2e-4)


def test_what_can_be_coded():
    r = coders.Registry()
    assert r.can_decode("pcm-s16") and r.can_encode_audio("ulaw") and not r.can_encode("aac") and not r.can_decode_video("avc")
    assert r.can_encode_subtitles("webvtt") and r.encodable_subtitles() == ["webvtt"] and not r.can_encode_audio("ulaw", channels=0)
    r.register("avc", lambda state, data: None)
    r.register_encoder("vp9", lambda state, image, key: (b"", key))
    r.register_encoder("aac", lambda x, channels: b"")
    assert r.can_decode_video("avc") and not r.can_decode_audio("avc") and r.decodable_video() == ["avc"]
    assert r.can_encode_video("vp9") and not r.can_encode_video("vp9", width=0) and r.encodable_video() == ["vp9"]
    assert r.encodable_audio()[0] == "aac" and r.first_encodable(["av1", "hevc", "vp9"]) == "vp9" and r.first_encodable(["av1"]) is None


def toy() -> coders.Registry:
    """Frames of one grey; a delta packet holds the difference to the frame before."""
    r = coders.Registry()

    def encode(state, image, key):
        value = round(float(image[0, 0, 0]) * 255)
        out = bytes([75, value]) if key else bytes([68, (value - state["last"]) % 256])
        state["last"] = value
        return out, key

    def decode(state, data):
        if not data:
            return None
        state["last"] = data[1] if data[0] == 75 else (state["last"] + data[1]) % 256
        return np.dstack([np.full((2, 2), state["last"] / 255)] * 3 + [np.ones((2, 2))])

    r.register_encoder("vp8", encode)
    r.register("vp8", decode)
    r.register_transformer("invert", lambda image: np.dstack([1 - image[..., :3], image[..., 3:]]))
    return r


def test_video_coders_keep_state_by_track(spark):
    r = toy()
    greys = {(f, i): (37 * i + 11 * ord(f)) % 256 for f in "ab" for i in range(40)}
    rows = [(f, 1, i, i * 0.1, 0.1, "RGBA", 2, 2, 0, bytearray(bytes([g, g, g, 255]) * 4)) for (f, i), g in greys.items()]
    frames = spark.createDataFrame(rows, pixels.FRAMES).repartition(5)
    packets = coders.encode_video(frames, r, "vp8", key_interval=1.0)
    kinds = {(x["file_id"], x["seq"]): x["type"] for x in packets.collect()}
    assert sum(k == "key" for k in kinds.values()) == 8 and kinds["a", 0] == kinds["b", 10] == "key" and kinds["a", 11] == "delta"
    back = coders.decode_video(packets, r, "vp8")
    assert {(x["file_id"], x["seq"]): x["data"][0] for x in back.collect()} == greys
    negative = coders.transform_video(back, r, "invert")
    assert {(x["file_id"], x["seq"]): 255 - x["data"][0] for x in negative.collect()} == greys
    with pytest.raises(ValueError):
        coders.decode_video(packets, r, "avc")


def test_audio_both_ways(spark):
    rows = [("f", 1, i, i * 0.02, 1, 50, [i / 10, -i / 10]) for i in range(5)]
    samples = spark.createDataFrame(rows, "file_id string, track_id int, seq long, timestamp double, channels int, sample_rate int, samples array<float>")
    r = coders.Registry()
    packets = coders.encode_audio(samples, r, "pcm-f32")
    assert [x["duration"] for x in packets.collect()] == [0.04] * 5
    back = coders.decode_audio(packets.withColumns({"codec": F.lit("pcm-f32"), "channels": F.lit(1), "sample_rate": F.lit(50)}), r)
    assert {x["seq"]: x["samples"] for x in back.collect()} == {x["seq"]: x["samples"] for x in samples.collect()}
    with pytest.raises(ValueError):
        coders.encode_audio(samples, r, "opus")

"""Raw frames: planes, colours, geometry."""

import numpy as np
import pytest

from tidemark.functions import pixels


@pytest.mark.parametrize(("format_", "size"), [("I420", 5 * 3 + 2 * 3 * 2), ("I420A", 5 * 3 * 2 + 2 * 3 * 2), ("I422", 5 * 3 + 2 * 3 * 3), ("I444", 45), ("NV12", 15 + 6 * 2), ("RGBA", 60), ("I420P10", 2 * (15 + 12))])
def test_sizes_of_odd_frames(format_, size):
    assert pixels.allocation_size(format_, 5, 3) == size
    parts = pixels.planes(format_, 5, 3)
    assert parts[0].offset == 0 and all(b.offset == a.offset + a.stride * a.rows for a, b in zip(parts, parts[1:], strict=False))
    with pytest.raises(ValueError):
        pixels.planes("I421", 2, 2)


@pytest.mark.parametrize("format_", ["RGBA", "BGRA", "I444", "I444A", "I420", "NV12", "I422", "I444P10"])
@pytest.mark.parametrize("full", [True, False])
def test_colours_survive_a_round_trip(format_, full):
    r = np.random.default_rng(1)
    flat = np.broadcast_to(r.random((1, 1, 4)), (4, 6, 4)).copy()  # one colour: halved chroma loses nothing
    if not pixels.has_alpha(format_):
        flat[..., 3] = 1
    data = pixels.from_rgba(flat, format_, full_range=full)
    assert len(data) == pixels.allocation_size(format_, 6, 4)
    assert np.abs(pixels.to_rgba(data, format_, 6, 4, full_range=full) - flat).max() < 0.02
    with pytest.raises(ValueError):
        pixels.to_rgba(data[:-1], format_, 6, 4)


def test_known_colours():
    black = pixels.from_rgba(np.array([[[0, 0, 0, 1.0]]]), "I444")
    white = pixels.from_rgba(np.array([[[1, 1, 1, 1.0]]]), "I444")
    red = pixels.from_rgba(np.array([[[1, 0, 0, 1.0]]]), "I444", "smpte170m")
    assert list(black) == [16, 128, 128] and list(white) == [235, 128, 128] and list(red) == [81, 90, 240]


def test_geometry():
    image = np.arange(24, dtype=float).reshape(2, 3, 4) / 24
    assert np.array_equal(pixels.turn(image, 90)[0, 0], image[1, 0]) and np.array_equal(pixels.turn(pixels.turn(image, 270), 90), image)
    assert pixels.crop(image, -1, 1, 3, 9).shape == (1, 3, 4) and np.array_equal(pixels.scale(image, 3, 2), image)
    wide = pixels.fit(np.ones((2, 4, 4)), 4, 4, "contain")
    assert wide[0, 0].tolist() == [0, 0, 0, 1] and wide[1, 0].tolist() == [1, 1, 1, 1] and pixels.fit(image, 2, 2, "cover").shape == (2, 2, 4)
    t = pixels.Transform(crop=(0, 0, 100, 50), rotate=90, width=25)
    assert t.size(640, 480) == (25, 50) and pixels.Transform(height=90).size(640, 480) == (120, 90)


def test_alpha():
    image = np.random.default_rng(2).random((3, 3, 4))
    assert np.allclose(pixels.merge_alpha(*pixels.split_alpha(image)), image)
    assert np.allclose(pixels.draw(np.array([[[1, 0, 0, 0.5]]]), np.array([[[0, 0, 1, 1.0]]])), [[[0.5, 0, 0.5, 1]]])


def test_frames_in_spark(spark):
    image = np.random.default_rng(3).random((4, 6, 4))
    data = pixels.from_rgba(image, "RGBA")
    rows = spark.createDataFrame([("f", 1, i, i / 25, 0.04, "RGBA", 6, 4, 90 * i, bytearray(data)) for i in range(3)], pixels.FRAMES)
    out = {r["seq"]: r for r in pixels.transform_frames(rows, pixels.Transform(width=8, height=2, format="I420")).collect()}
    assert all((r["format"], r["width"], r["height"], r["rotation"], len(r["data"])) == ("I420", 8, 2, 0, 24) for r in out.values())
    same = {r["seq"]: r for r in pixels.transform_frames(rows, pixels.Transform()).collect()}
    assert bytes(same[0]["data"]) == data and (same[1]["width"], same[1]["height"]) == (4, 6)
    assert pixels.transform_frames(rows.limit(0), pixels.Transform()).count() == 0

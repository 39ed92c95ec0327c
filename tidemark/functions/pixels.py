"""Raw video frames: planes, colour conversion, cropping, turning, fitting into a box, alpha. Plain numpy, applied to rows of frames batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: By pixel format, each plane's samples a pixel and how its width and height are halved (shifts).
PLANES: dict[str, list[tuple[int, int, int]]] = {
    "I420": [(1, 0, 0), (1, 1, 1), (1, 1, 1)],
    "I420A": [(1, 0, 0), (1, 1, 1), (1, 1, 1), (1, 0, 0)],
    "I422": [(1, 0, 0), (1, 1, 0), (1, 1, 0)],
    "I422A": [(1, 0, 0), (1, 1, 0), (1, 1, 0), (1, 0, 0)],
    "I444": [(1, 0, 0), (1, 0, 0), (1, 0, 0)],
    "I444A": [(1, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0)],
    "NV12": [(1, 0, 0), (2, 1, 1)],
    "RGBA": [(4, 0, 0)],
    "RGBX": [(4, 0, 0)],
    "BGRA": [(4, 0, 0)],
    "BGRX": [(4, 0, 0)],
}
#: Weights of red and blue in luma, by matrix.
MATRICES = {"bt709": (0.2126, 0.0722), "smpte170m": (0.299, 0.114), "bt470bg": (0.299, 0.114), "bt2020-ncl": (0.2627, 0.0593)}


@dataclass(frozen=True)
class Plane:
    """A plane's place in a frame without padding: first byte, bytes a row, rows."""

    offset: int
    stride: int
    rows: int


def base_format(format_: str) -> tuple[str, int]:
    """The layout and the bits of a sample: I420P10 is I420 with 10 bits in two bytes."""
    name, mark, bits = format_.partition("P")
    if mark and bits.isdigit() and name in PLANES:
        return name, int(bits)
    if format_ not in PLANES:
        raise ValueError(f"unknown pixel format {format_}")
    return format_, 8


def planes(format_: str, width: int, height: int) -> list[Plane]:
    """Where the planes of a frame lie; halved sizes are rounded up."""
    name, bits = base_format(format_)
    out, at = [], 0
    for samples, across, down in PLANES[name]:
        stride = samples * ((width + across) >> across) * (2 if bits > 8 else 1)
        rows = (height + 1) >> 1 if down else height
        out.append(Plane(at, stride, rows))
        at += stride * rows
    return out


def allocation_size(format_: str, width: int, height: int) -> int:
    """Bytes of a frame without padding."""
    return sum(p.stride * p.rows for p in planes(format_, width, height))


def has_alpha(format_: str) -> bool:
    return base_format(format_)[0] in ("RGBA", "BGRA", "I420A", "I422A", "I444A")


def _samples(data: bytes, format_: str, width: int, height: int) -> list[np.ndarray]:
    """Each plane as rows of samples in 0 to 1."""
    _, bits = base_format(format_)
    if len(data) < allocation_size(format_, width, height):
        raise ValueError("the frame is shorter than its planes")
    kind = np.dtype("<u2") if bits > 8 else np.dtype(np.uint8)
    return [np.frombuffer(data, kind, p.stride * p.rows // kind.itemsize, p.offset).reshape(p.rows, -1) / float((1 << bits) - 1) for p in planes(format_, width, height)]


def _bytes(values: np.ndarray, bits: int) -> bytes:
    return np.clip(np.rint(values * ((1 << bits) - 1)), 0, (1 << bits) - 1).astype("<u2" if bits > 8 else np.uint8).tobytes()


def _range(full: bool) -> tuple[float, float, float]:
    """Least luma, its span, and the span of chroma."""
    return (0.0, 1.0, 1.0) if full else (16 / 255, 219 / 255, 224 / 255)


def to_rgba(data: bytes, format_: str, width: int, height: int, matrix: str = "bt709", full_range: bool = False) -> np.ndarray:
    """A frame as height x width x 4 values in 0 to 1; chroma is repeated, alpha is 1 where there is none."""
    name, _ = base_format(format_)
    parts = _samples(data, format_, width, height)
    if name[:3] in ("RGB", "BGR"):
        out = parts[0].reshape(height, width, 4).copy()
        out = out[..., [2, 1, 0, 3]] if name[0] == "B" else out
        if name[3] == "X":
            out[..., 3] = 1
        return out
    if name == "NV12":
        pair = parts[1].reshape(parts[1].shape[0], -1, 2)
        chroma = [pair[..., 0], pair[..., 1]]
    else:
        chroma = parts[1:3]
    u, v = (c.repeat(-(-height // c.shape[0]), 0)[:height].repeat(-(-width // c.shape[1]), 1)[:, :width] for c in chroma)
    low, span, chroma_span = _range(full_range)
    y, u, v = (parts[0] - low) / span, (u - 128 / 255) / chroma_span, (v - 128 / 255) / chroma_span
    red, blue = MATRICES[matrix]
    r, b = y + 2 * (1 - red) * v, y + 2 * (1 - blue) * u
    g = (y - red * r - blue * b) / (1 - red - blue)
    alpha = parts[3] if len(parts) > 3 else np.ones_like(y)
    return np.clip(np.stack([r, g, b, alpha], axis=-1), 0, 1)


def from_rgba(image: np.ndarray, format_: str, matrix: str = "bt709", full_range: bool = False) -> bytes:
    """The frame's bytes in a format; chroma is the mean of what it covers."""
    name, bits = base_format(format_)
    if name[:3] in ("RGB", "BGR"):
        out = image[..., [2, 1, 0, 3]] if name[0] == "B" else image
        return _bytes(out, 8)
    red, blue = MATRICES[matrix]
    r, g, b = image[..., 0], image[..., 1], image[..., 2]
    y = red * r + (1 - red - blue) * g + blue * b
    low, span, chroma_span = _range(full_range)
    u, v = (b - y) / (2 * (1 - blue)) * chroma_span + 128 / 255, (r - y) / (2 * (1 - red)) * chroma_span + 128 / 255
    _, across, down = PLANES[name][1]

    def mean(c: np.ndarray) -> np.ndarray:
        if down:
            c = (c[0::2] + np.vstack([c, c[-1:]])[1::2][: -(-c.shape[0] // 2)]) / 2
        if across:
            c = (c[:, 0::2] + np.hstack([c, c[:, -1:]])[:, 1::2][:, : -(-c.shape[1] // 2)]) / 2
        return c

    parts = [y * span + low]
    parts += [np.stack([mean(u), mean(v)], axis=-1)] if name == "NV12" else [mean(u), mean(v)]
    parts += [image[..., 3]] if name.endswith("A") else []
    return b"".join(_bytes(p, bits) for p in parts)


def crop(image: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """The part of an image within a rectangle, which is clamped to it."""
    top, left = max(0, top), max(0, left)
    return image[top : min(image.shape[0], top + height), left : min(image.shape[1], left + width)]


def turn(image: np.ndarray, degrees: int) -> np.ndarray:
    """An image turned clockwise by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError("only quarter turns")
    return np.rot90(image, -(degrees // 90) % 4)


def scale(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Another size, by straight lines between pixel centres."""

    def places(size: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(target) + 0.5) * size / target - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = places(image.shape[0], height)
    x0, x1, fx = places(image.shape[1], width)
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def fit(image: np.ndarray, width: int, height: int, how: str = "fill", background: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0)) -> np.ndarray:
    """An image in a box: "fill" stretches it, "contain" shows all of it on a background, "cover" cuts what sticks out."""
    if how == "fill":
        return scale(image, width, height)
    if how not in ("contain", "cover"):
        raise ValueError(f"unknown fit {how}")
    ratios = width / image.shape[1], height / image.shape[0]
    ratio = min(ratios) if how == "contain" else max(ratios)
    w, h = max(1, round(image.shape[1] * ratio)), max(1, round(image.shape[0] * ratio))
    scaled = scale(image, w, h)
    if how == "cover":
        return crop(scaled, (w - width) // 2, (h - height) // 2, width, height)
    out = np.broadcast_to(np.array(background, float), (height, width, 4)).copy()
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = draw(scaled, out[top : top + h, left : left + w])
    return out


def draw(image: np.ndarray, under: np.ndarray) -> np.ndarray:
    """An image over another of its size, by its alpha."""
    a = image[..., 3:]
    alpha = a + under[..., 3:] * (1 - a)
    colour = (image[..., :3] * a + under[..., :3] * under[..., 3:] * (1 - a)) / np.where(alpha > 0, alpha, 1)
    return np.concatenate([colour, alpha], axis=-1)


def split_alpha(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An opaque image, and its alpha as a grey one."""
    colour, alpha = image.copy(), image[..., 3]
    colour[..., 3] = 1
    return colour, np.stack([alpha, alpha, alpha, np.ones_like(alpha)], axis=-1)


def merge_alpha(colour: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """What split_alpha took apart."""
    return np.concatenate([colour[..., :3], alpha[..., :1]], axis=-1)


@dataclass(frozen=True)
class Transform:
    """What is done to a frame, in this order: crop (left, top, width, height), turn, fit into a box."""

    crop: tuple[int, int, int, int] | None = None
    rotate: int = 0
    width: int | None = None
    height: int | None = None
    fit: str = "fill"
    format: str | None = None
    discard_alpha: bool = False

    def size(self, width: int, height: int) -> tuple[int, int]:
        """The size that a frame of this size has afterwards; a missing side keeps the shape, even numbers."""
        if self.crop:
            left, top, w, h = self.crop
            width, height = max(0, min(width, left + w) - max(0, left)), max(0, min(height, top + h) - max(0, top))
        if self.rotate % 180:
            width, height = height, width
        if self.width and self.height:
            return self.width, self.height
        even = lambda x: max(2, 2 * round(x / 2))
        if self.width:
            return self.width, even(height * self.width / width)
        if self.height:
            return even(width * self.height / height), self.height
        return width, height

    def apply(self, image: np.ndarray) -> np.ndarray:
        width, height = self.size(image.shape[1], image.shape[0])
        if self.crop:
            image = crop(image, *self.crop)
        image = turn(image, self.rotate)
        if (image.shape[1], image.shape[0]) != (width, height):
            image = fit(image, width, height, self.fit)
        if self.discard_alpha:
            image = merge_alpha(image, np.ones_like(image))
        return image


FRAMES = "file_id string, track_id int, seq long, timestamp double, duration double, format string, width int, height int, rotation int, data binary"


def transform_frames(frames: DataFrame, how: Transform, matrix: str = "bt709", full_range: bool = False) -> DataFrame:
    """Frames (FRAMES) after a transform; a frame's own rotation is applied before and is 0 afterwards."""
    names = [x.split()[0] for x in FRAMES.split(", ")]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a frame can be large: one at a time
                r = batch.slice(i, 1).to_pylist()[0]
                image = turn(to_rgba(r["data"], r["format"], r["width"], r["height"], matrix, full_range), r["rotation"] or 0)
                image, format_ = how.apply(image), how.format or r["format"]
                r |= {"format": format_, "width": image.shape[1], "height": image.shape[0], "rotation": 0, "data": from_rgba(image, format_, matrix, full_range)}
                yield pa.RecordBatch.from_pylist([r], kinds)

    return frames.select(*names).mapInArrow(run, FRAMES)

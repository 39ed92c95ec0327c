"""Video bitstreams: units, parameter sets, key frames; and the geometry of frames."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.model import Bits


def annex_b_units(data: bytes) -> Iterator[bytes]:
    """Units between start codes of three or four bytes."""
    at = data.find(b"\0\0\1")
    while at >= 0:
        end = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : end if end >= 0 else len(data)]
        if end >= 0:
            unit = unit.rstrip(b"\0")
        if unit:
            yield unit
        at = end


def prefixed_units(data: bytes, width: int = 4) -> Iterator[bytes]:
    """Units behind lengths of ``width`` bytes; a length that runs over the end ends the list."""
    at = 0
    while at + width <= len(data):
        n = int.from_bytes(data[at : at + width], "big")
        if at + width + n > len(data):
            return
        yield data[at + width : at + width + n]
        at += width + n


def to_annex_b(units: list[bytes]) -> bytes:
    return b"".join(b"\0\0\0\1" + u for u in units)


def to_prefixed(units: list[bytes], width: int = 4) -> bytes:
    return b"".join(len(u).to_bytes(width, "big") + u for u in units)


def unescape(unit: bytes) -> bytes:
    """Without the 3 that stands behind two zeros where four values would be ambiguous."""
    out, zeros = bytearray(), 0
    for b in unit:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def avc_sps(unit: bytes) -> dict:
    """Profile, level and size of an AVC sequence parameter set (with its unit header)."""
    b = Bits(unescape(unit)[1:])
    profile, flags, level = b.read(8), b.read(8), b.read(8)
    b.exp_golomb()
    chroma, depth = 1, 8
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135):
        chroma = b.exp_golomb()
        if chroma == 3:
            b.read(1)
        depth = b.exp_golomb() + 8
        b.exp_golomb()
        b.read(1)
        if b.read(1):  # scaling lists
            for i in range(8 if chroma != 3 else 12):
                if b.read(1):
                    last = following = 8
                    for _ in range(16 if i < 6 else 64):
                        if following:
                            following = (last + b.signed_exp_golomb()) & 255
                        last = following or last
    b.exp_golomb()
    order = b.exp_golomb()
    if order == 0:
        b.exp_golomb()
    elif order == 1:
        b.read(1)
        b.signed_exp_golomb()
        b.signed_exp_golomb()
        for _ in range(b.exp_golomb()):
            b.signed_exp_golomb()
    b.exp_golomb()
    b.read(1)
    width, height = 16 * (b.exp_golomb() + 1), b.exp_golomb() + 1
    frames_only = b.read(1)
    height *= 16 * (2 - frames_only)
    if not frames_only:
        b.read(1)
    b.read(1)
    if b.read(1):
        left, right, top, bottom = (b.exp_golomb() for _ in range(4))
        x, y = (1 if chroma in (0, 3) else 2), (2 if chroma == 1 else 1) * (2 - frames_only)
        width, height = width - x * (left + right), height - y * (top + bottom)
    return {"profile": profile, "compatibility": flags, "level": level, "chroma": chroma, "bit_depth": depth, "width": width, "height": height, "codec_string": f"avc1.{profile:02x}{flags:02x}{level:02x}"}


def avc_configuration(units: list[bytes]) -> bytes | None:
    """The decoder description from a key frame's units, or None without parameter sets."""
    sps, pps = ([u for u in units if u[0] & 31 == k] for k in (7, 8))
    if not sps or not pps:
        return None
    out = bytes([1, *sps[0][1:4], 0xFF, 0xE0 | len(sps)]) + b"".join(struct.pack(">H", len(u)) + u for u in sps) + bytes([len(pps)]) + b"".join(struct.pack(">H", len(u)) + u for u in pps)
    if sps[0][1] in (100, 110, 122, 144):
        s = avc_sps(sps[0])
        out += bytes([0xFC | s["chroma"], 0xF8 | s["bit_depth"] - 8, 0xF8 | s["bit_depth"] - 8, 0])
    return out


def parse_avc_configuration(data: bytes) -> dict:
    width, n = (data[4] & 3) + 1, data[5] & 31
    at, sets = 6, []
    for count in (n, None):
        if count is None:
            count, at = data[at], at + 1
        found = []
        for _ in range(count):
            size = struct.unpack_from(">H", data, at)[0]
            found.append(data[at + 2 : at + 2 + size])
            at += 2 + size
        sets.append(found)
    return {"profile": data[1], "compatibility": data[2], "level": data[3], "length_size": width, "sps": sets[0], "pps": sets[1]}


def vp9_header(data: bytes) -> dict | None:
    """Profile and, for key frames, size of a VP9 frame."""
    b = Bits(data)
    if b.read(2) != 2:
        return None
    profile = b.read(1) | b.read(1) << 1
    if profile == 3:
        b.read(1)
    if b.read(1):
        return {"profile": profile, "key": False}
    key = not b.read(1)
    b.read(2)
    out = {"profile": profile, "key": key}
    if not key or b.read(24) != 0x498342:
        return out
    depth = 8 if profile < 2 else 12 if b.read(1) else 10
    if b.read(3) != 7:
        b.read(1)
        if profile in (1, 3):
            b.read(3)
    elif profile in (1, 3):
        b.read(1)
    return out | {"bit_depth": depth, "width": b.read(16) + 1, "height": b.read(16) + 1}


def av1_units(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and contents of the open bitstream units of a packet."""
    at = 0
    while at < len(data):
        head = data[at]
        kind, extended, sized = head >> 3 & 15, head & 4, head & 2
        at += 2 if extended else 1
        if sized:
            size = shift = 0
            while at < len(data):
                size |= (data[at] & 127) << shift
                shift += 7
                at += 1
                if not data[at - 1] & 128:
                    break
        else:
            size = len(data) - at
        yield kind, data[at : at + size]
        at += size


def packet_type(codec: str, data: bytes, length_size: int | None = None) -> str | None:
    """key or delta by what the bitstream says; None if that can't be told."""
    if not data:
        return None
    if codec in ("avc", "hevc"):
        units = list(prefixed_units(data, length_size) if length_size else annex_b_units(data))
        kinds = [u[0] & 31 if codec == "avc" else u[0] >> 1 & 63 for u in units if u]
        if codec == "avc":
            pictures = [k for k in kinds if 1 <= k <= 5]
            return None if not pictures else "key" if 5 in pictures else "delta"
        pictures = [k for k in kinds if k < 32]
        return None if not pictures else "key" if any(16 <= k <= 23 for k in pictures) else "delta"
    if codec == "vp8":
        return "delta" if data[0] & 1 else "key"
    if codec == "vp9":
        h = vp9_header(data)
        return None if h is None else "key" if h["key"] else "delta"
    if codec == "av1":
        reduced = False
        for kind, body in av1_units(data):
            if kind == 1 and body:
                reduced = bool(body[0] >> 3 & 1)
            elif kind in (3, 6) and body:
                if reduced:
                    return "key"
                if body[0] & 128:  # an existing frame is shown again
                    return "delta"
                return "key" if body[0] >> 5 & 3 == 0 else "delta"
        return None
    return "key" if codec == "prores" else None


@F.pandas_udf(StringType())
def determine_type(codec: pd.Series, data: pd.Series) -> pd.Series:
    """packet_type of rows; streams with start codes."""
    return pd.Series([None if c is None or d is None else packet_type(c, bytes(d)) for c, d in zip(codec, data, strict=True)])


def simplest(num: int, den: int) -> tuple[int, int]:
    g = math.gcd(num, den) or 1
    return num // g, den // g


def rational_approximation(x: float, most: int) -> tuple[int, int]:
    """The convergent of x's continued fraction with the largest denominator up to ``most``."""
    sign, x = (-1 if x < 0 else 1), abs(x)
    a, b, rest = (0, 1), (1, 0), x
    for _ in range(64):
        whole = math.floor(rest)
        c = (whole * b[0] + a[0], whole * b[1] + a[1])
        if c[1] > most:
            break
        a, b = b, c
        if rest == whole or abs(b[0] / b[1] - x) <= x * 2**-52:
            break
        rest = 1 / (rest - whole)
    return sign * b[0], b[1]


def pixel_aspect_ratio(square_width: Column, square_height: Column, coded_width: Column, coded_height: Column) -> Column:
    """Width to height of a pixel, in lowest terms, by Euclid's steps unrolled over an array."""
    num, den = square_width.cast("long") * coded_height, square_height.cast("long") * coded_width
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(num.alias("a"), den.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
    g = F.greatest(F.abs(steps["a"]), F.lit(1))
    return F.struct(F.floor(num / g).cast("long").alias("num"), F.floor(den / g).cast("long").alias("den"))


def clamp_crop(left: Column, top: Column, width: Column, height: Column, outer_width: Column, outer_height: Column) -> Column:
    """A crop rectangle within a frame."""
    x, y = F.least(left, outer_width), F.least(top, outer_height)
    return F.struct(x.alias("left"), y.alias("top"), F.least(width, outer_width - x).alias("width"), F.least(height, outer_height - y).alias("height"))


def fit_rectangle(fit: str, width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """Where a frame lies in a box: fill stretches, contain shows all of it, cover fills the box; centred."""
    sx, sy = box_width / width, box_height / height
    if fit == "fill":
        w, h = box_width.cast("double"), box_height.cast("double")
    else:
        s = F.least(sx, sy) if fit == "contain" else F.greatest(sx, sy)
        w, h = width * s, height * s
    return F.struct(((box_width - w) / 2).alias("x"), ((box_height - h) / 2).alias("y"), w.alias("width"), h.alias("height"))


def rotate(rotation: Column, by: Column) -> Column:
    """The nearest right angle of the sum, 0 to 270."""
    return (F.pmod(F.floor((rotation + by) / 90 + 0.5).cast("int"), F.lit(4)) * 90).cast("int")


def almost_integer(x: Column) -> Column:
    """Snaps to the nearest whole number within ten times the floating-point step."""
    near = F.floor(x + 0.5).cast("double")
    return F.when(F.abs(x / F.when(near == 0, F.lit(1.0)).otherwise(near) - F.when(near == 0, F.lit(0.0)).otherwise(F.lit(1.0))) < 10 * 2**-52, near).otherwise(x)

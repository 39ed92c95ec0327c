"""Audio functions on arrays of samples in [-1, 1], frames interleaved."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By (source, target) channels, the weights of the source channels in each target channel.
HALF = math.sqrt(0.5)
MIXES: dict[tuple[int, int], list[dict[int, float]]] = {
    (1, 2): [{0: 1}, {0: 1}],
    (1, 4): [{0: 1}, {0: 1}, {}, {}],
    (1, 6): [{}, {}, {0: 1}, {}, {}, {}],
    (2, 1): [{0: 0.5, 1: 0.5}],
    (2, 4): [{0: 1}, {1: 1}, {}, {}],
    (2, 6): [{0: 1}, {1: 1}, {}, {}, {}, {}],
    (4, 1): [{0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}],
    (4, 2): [{0: 0.5, 2: 0.5}, {1: 0.5, 3: 0.5}],
    (4, 6): [{0: 1}, {1: 1}, {}, {}, {2: 1}, {3: 1}],
    (6, 1): [{0: HALF, 1: HALF, 2: 1, 4: 0.5, 5: 0.5}],
    (6, 2): [{0: 1, 2: HALF, 4: HALF}, {1: 1, 2: HALF, 5: HALF}],
    (6, 4): [{0: 1, 2: HALF}, {1: 1, 2: HALF}, {4: 1}, {5: 1}],
}


def mix_weights(source: int, target: int) -> list[dict[int, float]]:
    """Channels without a rule are mapped one to one, missing ones are silent."""
    return MIXES.get((source, target)) or [{c: 1} if c < source else {} for c in range(target)]


def mix_channels(samples: Column, source: int, target: int) -> Column:
    """Interleaved samples in another number of channels."""
    weights = mix_weights(source, target)

    def channel(frame: Column, c: int) -> Column:
        total = None
        for s, w in weights[c].items():
            x = F.get(samples, frame * source + s).cast("double")
            x = x if w == 1 else x * F.lit(float(w))
            total = x if total is None else total + x
        return F.lit(0.0) if total is None else total

    frames = F.floor(F.size(samples) / source).cast("int")
    each = F.transform(F.sequence(F.lit(0), frames - 1), lambda f: F.array(*[channel(f, c) for c in range(target)]))
    return F.when(frames > 0, F.flatten(each)).otherwise(F.array().cast("array<double>"))


def quantise(samples: Column, kind: str) -> Column:
    """Samples as whole numbers of u8, s16 or s32, clamped. Writing and reading scale differently, so a round trip isn't exact."""
    v = lambda x: x.cast("double")
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi)).cast("long")
    rule = {
        "u8": lambda x: clamp(F.floor((v(x) + 1) * 127.5), 0, 255),
        "s16": lambda x: clamp(F.floor(v(x) * 32767 + 0.5), -32768, 32767),
        "s32": lambda x: clamp(F.floor(v(x) * 2147483647 + 0.5), -2147483648, 2147483647),
    }[kind]
    return F.transform(samples, rule)


def normalise(samples: Column, kind: str) -> Column:
    """Whole numbers as samples in [-1, 1]."""
    zero, scale = {"u8": (128, 128.0), "s16": (0, 32768.0), "s32": (0, 2147483648.0)}[kind]
    return F.transform(samples, lambda x: (x - zero).cast("double") / scale)


def trim(samples: Column, channels: int, start: Column, end: Column) -> Column:
    """The frames from start up to, without, end."""
    return F.slice(samples, start * channels + 1, (end - start) * channels)


def _magnitude(x: np.ndarray) -> np.ndarray:
    """The place of the highest set bit."""
    return np.frexp(x.astype(np.float64))[1] - 1


def ulaw_encode(x: np.ndarray) -> np.ndarray:
    """Whole numbers, full-range 16 bit, to mu-law bytes; magnitudes beyond 8191 saturate."""
    sign = np.where(x < 0, 0x80, 0)
    m = np.minimum(np.abs(x.astype(np.int64)) + 33, 0x1FFF)
    high = np.clip(_magnitude(m), 5, 12)
    low = (m >> (high - 4)) & 15
    return (~(sign | ((high - 5) << 4) | low)) & 0xFF


def ulaw_decode(b: np.ndarray) -> np.ndarray:
    c = ~b.astype(np.int64) & 0xFF
    high = ((c & 0x70) >> 4) + 5
    m = ((1 << high) | ((c & 15) << (high - 4)) | (1 << (high - 5))) - 33
    return np.where(c & 0x80, -m, m)


def alaw_encode(x: np.ndarray) -> np.ndarray:
    """Whole numbers to A-law bytes; magnitudes beyond 4095 saturate."""
    sign = np.where(x < 0, 0x80, 0)
    m = np.minimum(np.abs(x.astype(np.int64)), 0xFFF)
    high = np.clip(_magnitude(np.maximum(m, 1)), 4, 11)
    low = (m >> np.where(high == 4, 1, high - 4)) & 15
    return (sign | ((high - 4) << 4) | low) ^ 0x55


def alaw_decode(b: np.ndarray) -> np.ndarray:
    c = b.astype(np.int64) ^ 0x55
    high = ((c & 0x70) >> 4) + 4
    body = c & 15
    m = np.where(high == 4, ((c & 0x7F) << 1) | 1, (1 << high) | (body << (high - 4)) | (1 << np.maximum(high - 5, 0)))
    return np.where(c & 0x80, -m, m)


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def _highest(x: Column) -> Column:
    """The place of the highest set bit of a positive whole number."""
    return F.length(F.bin(x.cast("long"))) - 1


def _chord(x: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), _highest(F.greatest(x, F.lit(1)))))


def to_ulaw(samples: Column) -> Column:
    """ulaw_encode of every sample of an array."""

    def code(x: Column) -> Column:
        m = F.least(F.abs(x.cast("int")) + 33, F.lit(0x1FFF))
        high = _chord(m, 5, 12)
        body = F.when(x < 0, 0x80).otherwise(0) + (high - 5) * 16 + _shift("shiftright", m, high - 4).bitwiseAND(15)
        return (F.lit(255) - body).cast("int")

    return F.transform(samples, code)


def from_ulaw(codes: Column) -> Column:
    """ulaw_decode of every byte of an array."""

    def sample(b: Column) -> Column:
        c = F.lit(255) - b
        high = F.floor(c.bitwiseAND(0x70) / 16).cast("int") + 5
        m = _shift("shiftleft", F.lit(1), high) + _shift("shiftleft", c.bitwiseAND(15), high - 4) + _shift("shiftleft", F.lit(1), high - 5) - 33
        return F.when(c >= 0x80, -m).otherwise(m).cast("int")

    return F.transform(codes, sample)


def to_alaw(samples: Column) -> Column:
    """alaw_encode of every sample of an array."""

    def code(x: Column) -> Column:
        m = F.least(F.abs(x.cast("int")), F.lit(0xFFF))
        high = _chord(m, 4, 11)
        body = F.when(x < 0, 0x80).otherwise(0) + (high - 4) * 16 + _shift("shiftright", m, F.greatest(high - 4, F.lit(1))).bitwiseAND(15)
        return body.bitwiseXOR(F.lit(0x55)).cast("int")

    return F.transform(samples, code)


def from_alaw(codes: Column) -> Column:
    """alaw_decode of every byte of an array."""

    def sample(b: Column) -> Column:
        c = b.bitwiseXOR(F.lit(0x55))
        high = F.floor(c.bitwiseAND(0x70) / 16).cast("int") + 4
        low = c.bitwiseAND(15)
        m = F.when(high == 4, 2 * low + 1).otherwise(_shift("shiftleft", F.lit(1), high) + _shift("shiftleft", low, high - 4) + _shift("shiftleft", F.lit(1), F.greatest(high - 5, F.lit(0))))
        return F.when(c >= 0x80, -m).otherwise(m).cast("int")

    return F.transform(codes, sample)


def resample(samples: np.ndarray, channels: int, rate: int, target: int, start: float = 0.0) -> tuple[int, np.ndarray]:
    """Linear interpolation to another rate: the first output frame's number and the interleaved frames.

    Output frame i stands at i / target seconds; frames outside the source's
    range count as 0, so neighbouring inputs add up where they meet.
    """
    source = samples.reshape(-1, channels).astype(np.float64)
    n = len(source)
    first = max(0, math.floor(start * target))
    last = math.ceil((start + n / rate) * target)
    at = (np.arange(first, last) / target - start) * rate
    low = np.floor(at).astype(np.int64)
    part = (at - low)[:, None]

    def frame(i: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < n)
        return np.where(inside[:, None], source[np.clip(i, 0, max(0, n - 1))], 0.0) if n else np.zeros((len(i), channels))

    return first, (frame(low) + part * (frame(low + 1) - frame(low))).astype(np.float32).ravel()


def resample_column(samples: Column, start: Column, channels: int, rate: int, target: int) -> tuple[Column, Column]:
    """What ``resample`` gives, as columns: the first output frame's number, and the interleaved frames."""
    n = F.floor(F.size(samples) / channels).cast("long")
    first = F.greatest(F.lit(0), F.floor(start * target)).cast("long")
    last = F.ceil((start + n / F.lit(float(rate))) * target).cast("long")

    def frame(j: Column, c: int) -> Column:
        return F.when((j >= 0) & (j < n), F.get(samples, (j * channels + c).cast("int")).cast("double")).otherwise(0.0)

    def output(i: Column) -> Column:
        at = (i / F.lit(float(target)) - start) * rate
        low = F.floor(at).cast("long")
        return F.array(*[(frame(low, c) + (at - low) * (frame(low + 1, c) - frame(low, c))).cast("float") for c in range(channels)])

    frames = F.flatten(F.transform(F.sequence(first, last - 1), output))
    return first, F.when((n > 0) & (last > first), frames).otherwise(F.array().cast("array<float>"))


def resample_rows(rows: DataFrame, keys: Sequence[str], channels: int, rate: int, target: int) -> DataFrame:
    """keys, ``start`` (seconds) and ``samples`` to keys, first_frame and resampled samples."""
    first, samples = resample_column(F.col("samples"), F.col("start"), channels, rate, target)
    return rows.select(*keys, first.alias("first_frame"), samples.alias("samples"))


def mix_frames(pieces: DataFrame, keys: Sequence[str], channels: int) -> DataFrame:
    """keys, frame, channel, sample: where resampled pieces of a track overlap, their samples are added up."""
    each = pieces.select(*keys, "first_frame", F.posexplode("samples").alias("_i", "sample"))
    return each.groupBy(*keys, (F.col("first_frame") + F.floor(F.col("_i") / channels)).alias("frame"), (F.col("_i") % channels).alias("channel")).agg(F.sum(F.col("sample").cast("double")).alias("sample"))


def pcm_codec(c: Column) -> Column:
    """What a PCM codec's name says: data type, bytes a sample, byte order and the silent value."""
    bits = F.regexp_extract(c, r"^pcm-[suf](\d+)(be)?$", 1)
    kind = F.regexp_extract(c, r"^pcm-([suf])\d+(be)?$", 1)
    law = c.isin("ulaw", "alaw")
    return F.when(law | (kind != ""), F.struct(
        F.when(law, c).when(kind == "s", "signed").when(kind == "u", "unsigned").otherwise("float").alias("data_type"),
        F.when(law, F.lit(1)).otherwise((F.try_to_number(F.nullif(bits, F.lit("")), F.lit("99")) / 8).cast("int")).alias("bytes"),
        F.coalesce(~c.endswith("be"), F.lit(True)).alias("little_endian"),
        F.when(c == "ulaw", 255).when(c == "alaw", 213).when(kind == "u", F.lit(128)).otherwise(0).alias("silence"),
    ))

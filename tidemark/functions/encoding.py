"""From a quality to bit rates and quantisers, and codec names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named qualities; the quality curve; per codec its share of AVC's rate, its quantiser range (least, most, worst, best), and audio base rates.
LEVELS = {"very-low": 0.0, "low": 0.25, "medium": 0.5, "high": 0.75, "very-high": 1.0}
CURVE = (0.3, 2.5538)
REFERENCE_PIXELS, REFERENCE_BITRATE, PIXEL_POWER = 1920 * 1080, 3_000_000, 0.95
EFFICIENCY = {"avc": 1.0, "hevc": 0.6, "vp9": 0.6, "av1": 0.4, "vp8": 1.2, "prores": 220 / 3}
QUANTISERS = {"avc": (0, 51, 41, 16), "hevc": (0, 51, 41, 16), "vp9": (0, 63, 52, 20), "av1": (0, 255, 208, 80)}
AUDIO_RATES = {"aac": 128_000, "opus": 64_000, "mp3": 160_000, "vorbis": 64_000, "ac3": 384_000, "eac3": 192_000, "dts": 768_000}
AAC_STEPS = (96_000, 128_000, 160_000, 192_000)
MP3_STEPS = (8_000, 16_000, 24_000, 32_000, 40_000, 48_000, 64_000, 80_000, 96_000, 112_000, 128_000, 160_000, 192_000, 224_000, 256_000, 320_000)


def _by(c: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(c == k, F.lit(float(v))).otherwise(out)
    return out


def level(name: Column) -> Column:
    """The number of a named quality."""
    return _by(name, LEVELS)


def bitrate_factor(quality: Column) -> Column:
    return F.lit(CURVE[0]) * F.exp(F.lit(CURVE[1]) * quality)


def video_bitrate(codec: Column, width: Column, height: Column, quality: Column) -> Column:
    """Bits a second in whole thousands, rounded up; null for an unknown codec."""
    scale = F.pow(width.cast("double") * height / F.lit(float(REFERENCE_PIXELS)), F.lit(PIXEL_POWER))
    return (F.ceil(F.lit(float(REFERENCE_BITRATE)) * scale * _by(codec, EFFICIENCY) * bitrate_factor(quality) / 1000) * 1000).cast("long")


def quantiser(codec: Column, quality: Column) -> Column:
    """The quantiser of a quality within the codec's range; null where a codec has none."""
    out = F.lit(None).cast("int")
    for name, (least, most, worst, best) in QUANTISERS.items():
        value = F.floor(F.lit(worst) + F.lit(best - worst) * quality + 0.5)
        out = F.when(codec == name, F.least(F.greatest(value, F.lit(least)), F.lit(most)).cast("int")).otherwise(out)
    return out


def _nearest(x: Column, steps: tuple[int, ...]) -> Column:
    """The step nearest to x, the lower of two."""
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(s) - x).alias("d"), F.lit(s).alias("s")) for s in steps]))["s"]


def audio_bitrate(codec: Column, quality: Column) -> Column:
    """Bits a second in whole thousands; null for lossless codecs."""
    raw = _by(codec, AUDIO_RATES) * bitrate_factor(quality)
    fitted = F.when(codec == "aac", _nearest(raw, AAC_STEPS)).when(codec == "mp3", _nearest(raw, MP3_STEPS)).when(codec.isin("opus", "vorbis"), F.greatest(F.lit(6000.0), raw)).otherwise(raw)
    return (F.floor(fitted / 1000 + 0.5) * 1000).cast("long")


#: How codec strings begin, and the codec.
STRINGS = (("avc1", "avc"), ("avc3", "avc"), ("hev1", "hevc"), ("hvc1", "hevc"), ("vp09", "vp9"), ("vp9", "vp9"), ("av01", "av1"), ("vp8", "vp8"), ("vp08", "vp8"), ("ap", "prores"), ("mp4a.40.", "aac"), ("mp4a.67", "aac"), ("mp4a.69", "mp3"), ("mp4a.6B", "mp3"), ("mp4a.6b", "mp3"), ("mp3", "mp3"), ("opus", "opus"), ("vorbis", "vorbis"), ("flac", "flac"), ("ac-3", "ac3"), ("ac3", "ac3"), ("ec-3", "eac3"), ("eac3", "eac3"), ("dts", "dts"), ("ulaw", "ulaw"), ("alaw", "alaw"), ("wvtt", "webvtt"))


def codec_of(string: Column) -> Column:
    """The codec that a codec string names; PCM names stand for themselves; null if unknown."""
    out = F.when(string.startswith("pcm-"), string)
    for start, codec in STRINGS:
        out = out.when(string.startswith(start), codec)
    return out

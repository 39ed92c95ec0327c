"""What a container holds, in plain Python: parsers fill these, the reader turns them into rows."""

from __future__ import annotations

from dataclasses import dataclass, field


class MediaError(ValueError):
    """A file that its format doesn't allow."""


@dataclass
class Packet:
    seq: int
    ticks: int
    duration_ticks: int
    offset: int
    length: int
    key: bool = True
    data: bytes | None = None  # where the packet isn't one stretch of the file


@dataclass
class Track:
    track_id: int
    type: str
    codec: str | None
    resolution: float
    packets: list[Packet] = field(default_factory=list)
    language: str = "und"
    name: str | None = None
    codec_string: str | None = None
    internal_codec_id: str | None = None
    channels: int | None = None
    sample_rate: int | None = None
    width: int | None = None
    height: int | None = None
    rotation: int = 0
    description: bytes | None = None
    duration_ticks: int | None = None
    default: bool = True


@dataclass
class Media:
    format: str
    tracks: list[Track]
    tags: dict[str, str] = field(default_factory=dict)


class Bits:
    """Reads bits from the most significant one on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        end = self.at + n
        first, last = self.at // 8, -(-end // 8)
        if last > len(self.data):
            raise MediaError("the data ends within a field")
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - end)
        self.at = end
        return value & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n

    def exp_golomb(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
        return (1 << zeros) - 1 + (self.read(zeros) if zeros else 0)

    def signed_exp_golomb(self) -> int:
        k = self.exp_golomb()
        return (k + 1) // 2 if k & 1 else -(k // 2)

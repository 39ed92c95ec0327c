"""Checksums that containers use; none of them is the reflected CRC-32 that Spark has."""

from __future__ import annotations

import numpy as np


def _table(polynomial: int, bits: int) -> np.ndarray:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint64)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & full
        out[i] = c
    return out


_CRC32, _CRC8, _CRC16 = [_table(p, b).tolist() for p, b in ((0x04C11DB7, 32), (0x07, 8), (0x8005, 16))]


def crc32_forward(data: bytes, start: int = 0) -> int:
    """CRC-32 from the top bit down. Ogg starts at 0, MPEG tables at 0xFFFFFFFF."""
    c = start
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC32[(c >> 24) ^ b]
    return c


def ogg_crc(page: bytes) -> int:
    """The checksum of a page, its own field counted as zeros."""
    return crc32_forward(page[:22] + b"\0\0\0\0" + page[26:])


def mpeg_crc(section: bytes) -> int:
    return crc32_forward(section, 0xFFFFFFFF)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ b]
    return c

"""Common encryption of samples: counter mode, and chained blocks in a pattern. AES itself is Spark's own function, in the JVM.

Samples have data, key (16 bytes), iv (8 or 16 bytes) and ``parts``: an array of
(clear, protected) lengths that cover the sample; null or empty: all of it is protected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces


def _ranges(size: int, parts: list[dict] | None) -> list[tuple[int, int]]:
    """Places of the protected stretches."""
    if not parts:
        return [(0, size)]
    out, at = [], 0
    for p in parts:
        at += p["clear"]
        if at + p["protected"] > size:
            raise ValueError("the parts are longer than the sample")
        out.append((at, at + p["protected"]))
        at += p["protected"]
    return out


def _blocks(size: int, parts: list[dict] | None, crypt: int, skip: int) -> list[tuple[int, int]]:
    """Whole 16-byte blocks that are encrypted, stretch by stretch: first place and end of each run of them."""
    out = []
    for a, b in _ranges(size, parts):
        at = a
        while at + 16 <= b:
            n = min(crypt if skip else (b - at) // 16, (b - at) // 16)
            out.append((at, at + 16 * n))
            at += 16 * (n + skip)
    return out


def _stage(rows: DataFrame, f: Callable[[dict], bytes], name: str, needs: list[str]) -> DataFrame:
    """Adds a binary column that a function of the row, of its columns ``needs``, gives."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != name) + f", `{name}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != name]
            for part in pieces(batch):
                made = pa.array([f(r) for r in part.select(needs).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], made], names=[*keep, name])
            batch = part = made = None  # the next batch comes before a name is given anew

    return rows.mapInArrow(run, schema)


def _counters(size: Column) -> Column:
    """The counters of so many bytes from ``iv`` on, 16 bytes each, one more at a time.

    They are made in the JVM, so that samples go to Python once only: of 256
    counters all but the last byte is the same, and put into a text of those.
    """
    start = F.rpad(F.hex("iv"), 32, "0")
    part = lambda at, n: F.conv(F.substring(start, at, n), 16, 10).cast("long")
    first, blocks = part(31, 2), F.ceil(size / 16).cast("long")

    def shared(i: Column) -> Column:
        low = part(19, 12) + i
        mid = part(5, 14) + F.shiftright(low, 48)
        top = (part(1, 4) + F.shiftright(mid, 56)).bitwiseAND(F.lit(0xFFFF).cast("long"))
        digits = lambda c, n: F.lpad(F.hex(c), n, "0")
        return F.concat(digits(top, 4), digits(mid.bitwiseAND(F.lit((1 << 56) - 1)), 14), digits(low.bitwiseAND(F.lit((1 << 48) - 1)), 12))

    text = F.lit("".join(f"x{i:02X}" for i in range(256)))
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.shiftright(first + blocks, 8)), lambda i: F.replace(text, F.lit("x"), shared(i)))
    return F.unhex(F.array_join(runs, "")).substr((first * 16 + 1).cast("int"), (blocks * 16).cast("int"))


def decrypt_ctr(samples: DataFrame) -> DataFrame:
    """Adds ``clear``: counter mode (cenc). Encrypting is the same."""

    def mixed(r: dict) -> bytes:
        out, at = bytearray(r["data"]), 0
        for a, b in _ranges(len(out), r["parts"]):
            stream = r["_stream"][at : at + b - a]
            out[a:b] = (np.frombuffer(bytes(out[a:b]), np.uint8) ^ np.frombuffer(stream, np.uint8)).tobytes()
            at += b - a
        return bytes(out)

    whole = F.octet_length("data").cast("long")
    covered = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["protected"])
    counters = _counters(F.when(F.size("parts") > 0, covered).otherwise(whole))
    rows = samples.withColumn("_stream", F.aes_encrypt(counters, F.col("key"), F.lit("ECB"), F.lit("PKCS")))
    return _stage(rows, mixed, "clear", ["data", "parts", "_stream"]).drop("_stream")


def decrypt_cbcs(samples: DataFrame, crypt: int = 1, skip: int = 9) -> DataFrame:
    """Adds ``clear``: chained blocks in a pattern (cbcs), ``crypt`` blocks encrypted and ``skip`` left; skip 0 encrypts all whole blocks. The chain begins anew in each part."""

    def gathered(r: dict) -> bytes:
        return b"".join(bytes(r["data"][a:b]) for a, b in _blocks(len(r["data"]), r["parts"], crypt, skip))

    def opened(r: dict) -> bytes:
        out, at = bytearray(r["data"]), 0
        runs = _blocks(len(out), r["parts"], crypt, skip)
        starts = {a for a, _ in _ranges(len(out), r["parts"])}
        before = bytes(r["iv"]).ljust(16, b"\0")
        for a, b in runs:
            if a in starts:
                before = bytes(r["iv"]).ljust(16, b"\0")
            coded = bytes(r["data"][a:b])
            chain = before + coded[:-16]
            out[a:b] = (np.frombuffer(r["_raw"][at : at + b - a], np.uint8) ^ np.frombuffer(chain, np.uint8)).tobytes()
            before, at = coded[-16:], at + b - a
        return bytes(out)

    # Spark wants padding at the end: the block that padding alone gives is put there.
    padding = F.aes_encrypt(F.lit(b"").cast("binary"), F.col("key"), F.lit("ECB"), F.lit("PKCS"))
    rows = _stage(samples, gathered, "_coded", ["data", "parts"]).withColumn("_raw", F.aes_decrypt(F.concat(F.col("_coded"), padding), F.col("key"), F.lit("ECB"), F.lit("PKCS")))
    return _stage(rows, opened, "clear", ["data", "parts", "iv", "_raw"]).drop("_coded", "_raw")

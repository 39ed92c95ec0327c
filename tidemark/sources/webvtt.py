"""WebVTT text as cues, and cues as WebVTT."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_subtitle_time
from ..schemas import CUES

ARROW = "-->"


def milliseconds(text: str) -> int | None:
    """A timestamp of the WebVTT grammar, two digits or more of hours being optional; None for anything else."""
    whole, dot, thousandths = text.partition(".")
    fields = whole.split(":")
    if not dot or len(thousandths) != 3 or len(fields) not in (2, 3) or not all(x.isascii() and x.isdigit() for x in (*fields, thousandths)):
        return None
    if len(fields[-1]) != 2 or len(fields[-2]) != 2 or len(fields[0]) < 2:
        return None
    total = 0
    for x in fields:
        total = 60 * total + int(x)
    return 1000 * total + int(thousandths)


def _timing(line: str) -> tuple[int, int, str] | None:
    """Start, end and settings of a line of cue timings."""
    before, arrow, after = line.partition(ARROW)
    end, _, settings = after.strip().partition(" ")
    start, stop = milliseconds(before.strip()), milliseconds(end.strip())
    return (start, stop, settings.strip()) if arrow and start is not None and stop is not None else None


def _blocks(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines that aren't empty."""
    held: list[str] = []
    for line in lines:
        if line:
            held.append(line)
        elif held:
            yield held
            held = []
    if held:
        yield held


def parse(text: str) -> tuple[str, list[dict]]:
    """The preamble (all before the first cue) and the cues, in the order of the text.

    A block is a cue if its first line, or the second after an identifier, holds
    timings; other blocks (notes, styles, regions) are kept as the notes of the
    cue that they stand before.
    """
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[0].split(maxsplit=1)[:1] != ["WEBVTT"] or lines[0][:1].isspace() or "" not in lines:
        raise ValueError("no WebVTT preamble")
    preamble, cues, notes = [], [], []
    for block in _blocks(lines):
        place = next((i for i, line in enumerate(block[:2]) if ARROW in line), None)
        timing = None if place is None else _timing(block[place])
        if timing is None:
            (notes if cues else preamble).append("\n".join(block))
            continue
        start, end, settings = timing
        cues.append({
            "ordinal": len(cues), "timestamp": start / 1000, "duration": (end - start) / 1000, "text": "\n".join(block[place + 1 :]).strip(), "identifier": block[0] if place else None, "settings": settings, "notes": "".join(x + "\n\n" for x in notes),
        })
        notes = []
    return "\n\n".join(preamble), cues


def read_cues(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per cue of each file."""
    kinds = [pa.field("file_id", pa.string()), pa.field("ordinal", pa.int32()), *(pa.field(n, t) for n, t in (("timestamp", pa.float64()), ("duration", pa.float64()), ("text", pa.string()), ("identifier", pa.string()), ("settings", pa.string()), ("notes", pa.string())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"file_id": p, **c} for c in parse(t)[1]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return files.select(path, text).mapInArrow(run, CUES)


def write_cues(cues: DataFrame, by: str = "file_id") -> DataFrame:
    """by, text: the cues of each file in time order as WebVTT."""
    ms = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    start, end = ms(F.col("timestamp")), ms(F.col("timestamp") + F.col("duration"))
    ident = F.when(F.col("identifier").isNotNull() & (F.col("identifier") != ""), F.concat("identifier", F.lit("\n"))).otherwise("")
    settings = F.when(F.col("settings").isNotNull() & (F.col("settings") != ""), F.concat(F.lit(" "), "settings")).otherwise("")
    block = F.concat(ident, format_subtitle_time(start), F.lit(" --> "), format_subtitle_time(end), settings, F.lit("\n"), F.col("text"))
    rows = cues.select(by, "timestamp", "ordinal", block.alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "ordinal", "block"))), lambda x: x["block"])
    return rows.groupBy(by).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n")).alias("text"))

"""Slots, gaps, chunks, segments and cues along a track's time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Empty slots that are made from one row at once.
STRETCH = 10_000


def slot_normalise(frames: DataFrame, keys: Sequence[str], slot_us: int) -> DataFrame:
    """Constant frame rate: one frame per slot of slot_us.

    A slot with frames shows its first one; an empty slot repeats the last
    frame of the nearest earlier slot that has any. Slots run to the end of
    the last frame. Repeats come from one row per occupied slot.
    """
    slot = F.floor(F.col("us") / slot_us).cast("long")
    rows = frames.withColumn("slot", slot)
    used = rows.groupBy(*keys, "slot").agg(F.min_by("seq", F.struct("us", "seq")).alias("first_seq"), F.max_by("seq", F.struct("us", "seq")).alias("last_seq"), F.max_by(F.col("us") + F.col("dur"), F.struct("us", "seq")).alias("end"))
    w = Window.partitionBy(*keys).orderBy("slot")
    final = F.floor(F.col("end") / slot_us).cast("long") - 1
    upto = F.greatest("slot", F.coalesce(F.lead("slot").over(w) - 1, final))
    # A gap of any length comes as stretches of at most STRETCH slots, so that no row holds a long array.
    spans = used.withColumn("upto", upto).select(*keys, "slot", "first_seq", "last_seq", "upto", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upto") - F.col("slot")) / STRETCH).cast("long"))).alias("_k"))
    begin = F.col("slot") + F.col("_k") * STRETCH
    each = spans.select(*keys, "slot", "first_seq", "last_seq", F.explode(F.sequence(begin, F.least("upto", begin + (STRETCH - 1)))).alias("at"))
    return each.select(*keys, F.col("at").alias("slot"), F.when(F.col("at") == F.col("slot"), F.col("first_seq")).otherwise(F.col("last_seq")).alias("seq"), (F.col("at") != F.col("slot")).alias("repeated"))


def key_frame_rhythm(frames: DataFrame, keys: Sequence[str], interval_us: int) -> DataFrame:
    """Adds ``force_key``: the first frame, and every frame that begins another interval (all if it is 0)."""
    if interval_us == 0:
        return frames.withColumn("force_key", F.lit(True))
    cell = F.floor(F.col("us") / interval_us)
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    return frames.withColumn("force_key", ~cell.eqNullSafe(F.lag(cell).over(w)))


def gap_fill(samples: DataFrame, keys: Sequence[str], least_us: int) -> DataFrame:
    """The samples and, where one starts least_us or more after the end of the one before it, a silent filler (``filler``)."""
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    rows = samples.withColumn("_end", F.lag(F.col("us") + F.col("dur")).over(w))
    gaps = rows.filter(F.col("us") - F.col("_end") >= least_us).select(*keys, F.col("seq"), F.col("_end").alias("us"), (F.col("us") - F.col("_end")).alias("dur"), F.lit(True).alias("filler"))
    return rows.select(*keys, "seq", "us", "dur", F.lit(False).alias("filler")).unionByName(gaps)


def _greedy(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], step, out: str, kind: str) -> DataFrame:
    """Numbers the rows of each track, in decode order, by a rule that depends on all rows before.

    The rows of a track are in one task, but come as a stream of batches, so
    memory doesn't grow with the track: rows are dealt by track, sorted, and a
    rule's state is carried from row to row.
    """
    names = [*keys, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            data = batch.to_pydict()
            found = []
            for i in range(batch.num_rows):
                now = tuple(data[k][i] for k in keys)
                if now != key:
                    key, state = now, None
                value, state = step(state, {c: data[c][i] for c in columns})
                found.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, out])

    plain = rows.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, f"{schema}, {out} {kind}")


def chunking(samples: DataFrame, keys: Sequence[str], least_us: int = 500_000) -> DataFrame:
    """Adds ``chunk``: a new one starts with a sample that begins least_us or more after the chunk's first."""

    def step(state, row):
        if state is None:
            return 0, (0, row["us"])
        chunk, start = state
        if row["us"] - start >= least_us:
            chunk, start = chunk + 1, row["us"]
        return chunk, (chunk, start)

    return _greedy(samples, keys, ["seq", "us"], step, "chunk", "long")


def segment_greedy(packets: DataFrame, keys: Sequence[str], target_us: int = 2_000_000) -> DataFrame:
    """Adds ``segment``: cuts at the last key packet that begins within target_us of the segment's start, or the first later one.

    Needs the key packets of one segment ahead only: segments are decided on
    key packets, of which each opens a group of pictures, and every packet
    follows its group.
    """
    from .packets import gop_index

    rows = gop_index(packets, keys)
    heads = rows.filter("key").select(*keys, "seq", "us", F.col("gop"))
    nxt = Window.partitionBy(*keys).orderBy("seq")
    heads = heads.withColumn("next_us", F.lead("us").over(nxt))

    def step(state, row):
        if state is None:
            return 0, (0, row["us"], False)
        segment, start, cut = state
        # A key packet opens a segment if it lies beyond the target, or if the next one would.
        beyond = row["us"] - start > target_us
        last_within = row["next_us"] is not None and row["next_us"] - start > target_us
        if beyond or last_within:
            return segment + 1, (segment + 1, row["us"], True)
        return segment, (segment, start, False)

    numbered = _greedy(heads, keys, ["seq", "us", "gop", "next_us"], step, "segment", "long")
    joined = rows.join(numbered.select(*keys, "gop", "segment"), [*keys, "gop"], "left")
    return joined.withColumn("segment", F.coalesce("segment", F.lit(0).cast("long"))).drop("gop")


def cue_flatten(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint intervals between all starts and ends of a track's cues, with how many cues are shown in each.

    A running sum of +1 at starts and -1 at ends counts the cues; no interval
    is joined with all cues.
    """
    starts = cues.select(*keys, F.col("us").alias("t"), F.lit(1).alias("d"))
    ends = cues.select(*keys, (F.col("us") + F.col("dur")).alias("t"), F.lit(-1).alias("d"))
    steps = starts.unionByName(ends).groupBy(*keys, "t").agg(F.sum("d").cast("long").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    rows = steps.withColumns({"end_us": F.lead("t").over(w), "shown": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.filter("end_us is not null").select(*keys, F.col("t").alias("start_us"), "end_us", "shown")


def cues_shown(cues: DataFrame, keys: Sequence[str], ident: str, bucket_us: int = 60_000_000) -> DataFrame:
    """The intervals of cue_flatten in which a cue is shown, with the sorted ids of all that are.

    Intervals and cues meet by time buckets of a fixed width, so a cue is
    compared with the intervals near it, not with all of its track.
    """
    parts = cue_flatten(cues, keys).filter("shown > 0")
    bucket = lambda c: F.floor(c / F.lit(bucket_us)).cast("long")
    left = parts.withColumn("_bucket", bucket(F.col("start_us")))
    right = cues.filter("dur > 0").select(*keys, F.col(ident).alias("_id"), F.col("us").alias("_from"), (F.col("us") + F.col("dur")).alias("_to"))
    right = right.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    met = left.join(right, [*keys, "_bucket"]).filter((F.col("_from") <= F.col("start_us")) & (F.col("start_us") < F.col("_to")))
    return met.groupBy(*keys, "start_us", "end_us").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


def floor_to_multiple(value: Column, step: int) -> Column:
    """The greatest multiple of a whole step that is no greater."""
    return (F.floor(value / step).cast("long") * step).cast("long")


def round_to_multiple(value: Column, step: int) -> Column:
    """The nearest multiple of a whole step; halves go up."""
    return floor_to_multiple(value + step // 2, step)


def segments_of(packets: DataFrame, keys: Sequence[str], segment: Column) -> DataFrame:
    """Segments of a track with their sizes, numbered from 0."""
    rows = packets.withColumn("_s", segment).groupBy(*keys, "_s").agg(F.min("us").alias("us"), (F.max(F.col("us") + F.col("dur")) - F.min("us")).alias("dur"), F.sum("bytes").alias("bytes"))
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy("_s")) - 1).cast("long")).drop("_s")

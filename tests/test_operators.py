"""Packet, track and timeline operators on small tables with edges: empty, single rows, ties, nulls, before the first and after the last."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import audio, rates, text
from tidemark.operators import packets as pk
from tidemark.operators import stats, timeline, tracks
from tidemark.plans import conversion

P = "track long, seq long, us long, dur long, bytes long, key boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, P)


def some(seed=1, n=60, tracks_=3):
    r = random.Random(seed)
    out = []
    for t in range(tracks_):
        us = sorted(r.sample(range(0, 10_000), n))
        for k in range(0, n, 4):
            us[k : k + 4] = [us[k : k + 4][i] for i in ((0, 3, 1, 2) if len(us[k : k + 4]) == 4 else range(len(us[k : k + 4])))]
        out += [(t, i, u, r.randint(0, 50), r.randint(1, 99), i % 12 == 0) for i, u in enumerate(us)]
    return out


@pytest.mark.parametrize("bucket", [10**12, 700, 1])
def test_as_of_against_a_loop(spark, bucket):
    rows = some()
    r = random.Random(2)
    probes = [(r.choice([0, 1, 2, 9]), i, r.randint(-100, 11_000)) for i in range(200)] + [(1, 500, None), (1, 501, rows[70][2])]
    q = spark.createDataFrame(probes, "track long, id long, us long")
    base = table(spark, rows).select("track", "us", F.col("seq").alias("hit"))
    got = {x["id"]: x["hit"] for x in pk.as_of(q, base, ["track"], ["hit"], bucket_us=bucket).collect()}
    assert len(got) == len(probes)
    for t, i, us in probes:
        best = max(((b[2], b[1]) for b in rows if us is not None and b[0] == t and b[2] <= us), default=None)
        assert got[i] == (best[1] if best else None)


def test_as_of_empty_and_ties(spark):
    none = spark.createDataFrame([], "track long, us long, hit long")
    q = spark.createDataFrame([(1, 5), (None, 5)], "track long, us long")
    assert [r["hit"] for r in pk.as_of(q, none, ["track"], ["hit"]).collect()] == [None, None]
    tied = spark.createDataFrame([(1, 5, 7), (1, 5, 9), (1, 5, 8), (None, 4, 3)], "track long, us long, hit long")
    assert {r["track"]: r["hit"] for r in pk.as_of(q, tied, ["track"], ["hit"]).collect()} == {1: 9, None: 3}
    assert pk.as_of(q.limit(0), tied, ["track"], ["hit"]).count() == 0


def test_range_scan_covers_its_start(spark):
    rows = [(1, i, 10 * i, 10, 1, True) for i in range(6)]
    got = pk.sample_range(table(spark, rows), ["track"], F.lit(25), F.lit(40)).collect()
    assert sorted(r["us"] for r in got) == [20, 30]
    assert [r["us"] for r in pk.sample_range(table(spark, rows), ["track"], F.lit(1000), F.lit(2000)).collect()] == [50]


def test_decode_times(spark):
    rows = some(4)
    got = {(r["track"], r["seq"]): r["dts"] for r in pk.decode_times(table(spark, rows), ["track"]).collect()}
    for t in range(3):
        mine = [r for r in rows if r[0] == t]
        for g in range(0, 60, 12):
            group = mine[g : g + 12]
            assert [got[t, r[1]] for r in group] == sorted(r[2] for r in group)


def test_timestamp_errors(spark):
    rows = [(1, 0, 0, 1, 1, True), (1, 1, 9, 1, 1, False), (1, 2, 5, 1, 1, True), (2, 0, 1, 1, 1, False), (3, 0, -1, 1, 1, True)]
    assert {(r["track"], r["seq"]): r["error"] for r in pk.timestamp_errors(table(spark, rows), ["track"]).collect()} == {(1, 0): None, (1, 1): None, (1, 2): "before_previous_group", (2, 0): "no_key_first", (3, 0): "negative"}


def test_interleave_against_a_merge(spark):
    rows = some(5)
    queues = {t: [r for r in rows if r[0] == t] for t in range(3)}
    want = []
    while any(queues.values()):
        t = min((t for t in queues if queues[t]), key=lambda t: (queues[t][0][2], t))
        want.append(queues[t].pop(0)[:2])
    got = pk.interleave(table(spark, rows).withColumn("file", F.lit(1)), ["file"], "track").orderBy("position").collect()
    assert [(r["track"], r["seq"]) for r in got] == want


def test_prefix_stats_against_a_loop(spark):
    rows = some(6)
    got = {r["track"]: r["packet_count"] for r in stats.packet_stats_prefix(table(spark, rows), ["track"], 10).collect()}
    for t in range(3):
        count, end = 0, None
        for r in (r for r in rows if r[0] == t):
            if count >= 10 and r[2] >= end:
                break
            count, end = count + 1, r[2] + r[3] if end is None else max(end, r[2] + r[3])
        assert got[t] == count


def test_stats_of_nothing_and_of_no_span(spark):
    assert stats.packet_stats(table(spark, []), ["track"]).count() == 0
    r = stats.packet_stats(table(spark, [(1, 0, 5, 0, 10, True)]), ["track"]).first()
    assert (r["packet_count"], r["span_us"], r["packet_rate"]) == (1, 0, None)


def test_slots(spark):
    rows = [(1, 0, 5, 5, 1, True), (1, 1, 12, 2, 1, True), (1, 2, 18, 2, 1, True), (1, 3, 41, 15, 1, True)]
    got = timeline.slot_normalise(table(spark, rows), ["track"], 10).orderBy("slot").collect()
    assert [(r["slot"], r["seq"], r["repeated"]) for r in got] == [(0, 0, False), (1, 1, False), (2, 2, True), (3, 2, True), (4, 3, False)]


def greedy(heads, target):
    """Segment numbers of key packets: cut at the last one that starts within the target, else at the first after."""
    out, segment, start = [0], 0, heads[0]
    for i in range(1, len(heads)):
        nxt = heads[i + 1] if i + 1 < len(heads) else None
        if heads[i] - start > target or (nxt is not None and nxt - start > target):
            segment, start = segment + 1, heads[i]
        out.append(segment)
    return out


def test_segments_in_batch_and_stream(spark, tmp_path):
    from tidemark.streaming import live

    r = random.Random(3)
    rows, us = [], 0
    for i in range(80):
        us += r.choice([100, 400, 900, 5000])
        rows.append((1, i, us, 50, r.randint(1, 9), i % 3 == 0))
    batch = timeline.segment_greedy(table(spark, rows), ["track"], 2000)
    got = {x["seq"]: x["segment"] for x in batch.collect()}
    heads = [x[2] for x in rows if x[5]]
    assert [got[i] for i in range(0, 80, 3)] == greedy(heads, 2000)
    # Several micro-batches, in decode order.
    for k in range(4):
        table(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = live.write_progressively(live.segment_stream(spark.readStream.schema(P).parquet(f"{tmp_path}/in"), 2000), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    done = {x["segment"]: (x["packets"], x["bytes"]) for x in spark.read.schema(live.SEGMENT_OUT).parquet(f"{tmp_path}/out").collect()}
    want = {s: (sum(v == s for v in got.values()), sum(x[4] for x in rows if got[x[1]] == s)) for s in set(got.values())}
    assert len(done) >= max(want) - 1 and all(done[s] == want[s] for s in done)
    assert live.live_window(spark.read.schema(live.SEGMENT_OUT).parquet(f"{tmp_path}/out"), ["track"], 2).count() == 2


def test_live_playlist_is_read_once(spark, tmp_path):
    from tidemark.streaming import live

    live.register(spark)
    path = tmp_path / "p.m3u8"
    head = "#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:{}\n"
    path.write_text(head.format(0) + "#EXTINF:2,\na\n#EXTINF:2,\nb\n")
    run = lambda: spark.readStream.format("live_playlist").option("path", str(path)).load().writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination()
    run()
    path.write_text(head.format(1) + "#EXTINF:2,\nb\n#EXTINF:2,\nc\n#EXT-X-ENDLIST\n")
    run()
    run()
    rows = spark.read.parquet(f"{tmp_path}/o").orderBy("seq_no").collect()
    assert [(r["seq_no"], r["path"].rsplit("/")[-1]) for r in rows] == [(0, "a"), (1, "b"), (2, "c")]


def test_track_queries(spark):
    rows = spark.createDataFrame([(1, 10, 5.0, True), (1, 11, None, True), (1, 12, 9.0, None), (2, 13, None, None)], "file long, ordinal long, bitrate double, good boolean")
    q = tracks.TrackQuery(F.col("ordinal") < 13, [tracks.prefer(F.col("good"))]).merge(tracks.TrackQuery(F.col("ordinal") > 9, [tracks.asc(F.col("bitrate"))]))
    assert [r["ordinal"] for r in q.apply(rows, by=["file"]).orderBy("rank").collect()] == [10, 11, 12]
    assert [r["ordinal"] for r in tracks.TrackQuery(sort_by=[tracks.desc(F.col("bitrate"))]).first(rows, ["file"]).orderBy("file").collect()] == [12, 13]
    m = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2]), (1, 3, [5]), (1, 4, None)], "file long, track long, members array<int>")
    assert {(r["a"], r["b"]) for r in tracks.pairs(m, m, "file", "track", "members").collect()} == {(1, 2), (2, 1)}
    assert {r["track"] for r in tracks.has_pairable(m, m, "file", "track", "members").collect()} == {1, 2}


def test_discard_reasons_and_plan(spark):
    rows = spark.createDataFrame([("f", i, "audio", c, i, 0, None, None) for i, c in enumerate(["mp3", "aac", None, "mp3", "ac3"])], "file_id string, track_id long, type string, codec string, ordinal int, rotation int, coded_width int, coded_height int")
    options = spark.createDataFrame([("audio", 0, False, None, None, None, False)], "type string, option int, discard boolean, target_codec string, width int, height int, force boolean")
    got = {r["track_id"]: (r["action"], r["output_codec"], r["reason"], r["pad_start"]) for r in conversion.plan(rows, options, "mp3").collect()}
    assert got[0] == ("copy", "mp3", None, True) and got[2][2] == "unknown_source_codec" and got[3][2] == "max_track_count_of_type_reached"
    got = {r["track_id"]: (r["action"], r["output_codec"]) for r in conversion.plan(rows, options, "mpegts").collect()}
    assert got[1] == ("copy", "aac") and got[4] == ("copy", "ac3")
    assert conversion.explain_invalid(conversion.plan(rows.filter("codec is null"), options, "mp3")).first()["reasons"] == {"unknown_source_codec": 1}
    # One input track to two outputs: fan-out by options.
    two = spark.createDataFrame([("video", 0, False, None, None, 480, False), ("video", 1, False, None, None, 360, False)], options.schema)
    video = spark.createDataFrame([("f", 1, "video", "avc", 0, 0, 1280, 720)], rows.schema)
    assert [(r["action"], r["output_width"], r["output_height"]) for r in conversion.plan(video, two, "mp4").orderBy("option").collect()] == [("transcode", 854, 480), ("transcode", 640, 360)]
    assert conversion.formats(spark).count() == len(conversion.FORMATS)


@pytest.mark.parametrize("quantise", [np.floor, lambda x: np.floor(x + 0.5), np.ceil])
@pytest.mark.parametrize(("rate", "resolution"), [(30, 30), (30, 1000), (24000 / 1001, 24000), (24000 / 1001, 1000), (25, 1_000_000)])
def test_frame_rate_fit(quantise, rate, resolution):
    i = np.arange(300)
    ticks = quantise(np.round(i / rate * resolution, 6))  # whole ticks stay whole
    assert rates.underlying_rate(ticks, resolution) == pytest.approx(rate)
    dropped = i[(i % 11 != 4) & (i % 17 != 9)]
    assert rates.underlying_rate(ticks[dropped], resolution) == pytest.approx(rate)


def test_frame_rate_of_long_and_late_tracks():
    n = int(3600 * 24000 / 1001)
    assert rates.underlying_rate(np.round(np.arange(n) * 1001 / 24000 * 1000), 1000) == 24000 / 1001
    assert rates.underlying_rate(np.round((1e9 + np.arange(300) / 30) * 1000), 1000) == 30
    assert rates.underlying_rate(np.arange(300) * 4000.0, 90000) == 22.5  # not a known rate
    odd = np.arange(400) * 3000.0
    odd[200:] += 1234  # one gap that no number of frames explains
    assert rates.underlying_rate(odd, 90000) == 30
    r = np.random.default_rng(1)
    assert rates.underlying_rate(np.cumsum(r.integers(10, 4000, 300)), 90000) is None


def test_frame_rate_without_one():
    assert rates.underlying_rate(np.array([0, 20, 50]), 100) is None
    assert rates.underlying_rate(np.array([5]), 100) is None and rates.underlying_rate(np.array([5, 5]), 100) is None
    assert rates.simplest_fraction(0.333, 0.334) == (1, 3) and rates.simplest_fraction(2.9, 3.05) == (3, 1)


def test_companding():
    x = np.arange(-32768, 32768)
    for encode, decode, top in ((audio.ulaw_encode, audio.ulaw_decode, 8031), (audio.alaw_encode, audio.alaw_decode, 4032)):
        b = encode(x)
        assert b.min() >= 0 and b.max() <= 255
        y = decode(b)
        assert y.max() == top and y.min() == -top
        small = np.abs(x) < 4000
        assert (np.abs(y - x)[small] <= np.maximum(32, np.abs(x[small]) / 16)).all()
        assert (np.diff(y[np.abs(x) < 4000]) >= 0).all()
        assert (encode(decode(np.arange(256)))[1:] == np.arange(1, 256)).mean() > 0.98


def test_mixing_trimming_and_quantising(spark):
    df = spark.createDataFrame([([0.5, -0.5, 1.0, 0.0],), ([],), (None,)], "s array<float>")
    rows = df.select(audio.mix_channels(F.col("s"), 2, 1).alias("m"), audio.mix_channels(F.col("s"), 2, 6).alias("six"), audio.trim(F.col("s"), 2, F.lit(1), F.lit(2)).alias("t"), audio.quantise(F.col("s"), "s16").alias("q"), audio.quantise(F.col("s"), "u8").alias("u")).collect()
    assert rows[0]["m"] == [0.0, 0.5] and rows[0]["six"] == [0.5, -0.5, 0, 0, 0, 0, 1.0, 0.0, 0, 0, 0, 0]
    assert rows[0]["t"] == [1.0, 0.0] and rows[0]["q"] == [16384, -16383, 32767, 0] and rows[0]["u"] == [191, 63, 255, 127]
    assert rows[1]["m"] == [] and rows[2]["q"] is None


def test_resampling():
    x = np.sin(np.arange(480) / 20).astype(np.float32)
    first, same = audio.resample(x, 1, 48000, 48000)
    assert first == 0 and np.allclose(same, x, atol=1e-6)
    _, half = audio.resample(x, 1, 48000, 24000)
    assert np.allclose(half, x[::2], atol=1e-6)
    assert len(audio.resample(np.zeros(0), 1, 48000, 24000)[1]) == 0


@pytest.mark.parametrize(
    ("base", "relative", "want"),
    [
        ("a/b/c.m3u8", "d.ts", "a/b/d.ts"), ("c.m3u8", "d.ts", "d.ts"), ("a/b/c", "../d", "a/d"), ("a/b/c", "./d", "a/b/d"), ("a/b/c", "/d", "/d"), ("http://h/a/b?x=/y/z", "c", "http://h/a/c"), ("http://h/a/b", "/c", "http://h/c"),
        ("http://h", "/c", "http://h/c"), ("http://h/a", "https://g/x", "https://g/x"),
    ],
)
def test_paths(spark, base, relative, want):
    got = spark.createDataFrame([(base, relative)], "b string, r string").select(text.join_paths(F.col("b"), F.col("r")).alias("p")).first()["p"]
    assert got == want == text.join_path(base, relative)


def test_text_functions(spark):
    df = spark.createDataFrame([("01:02:03.004",), ("02:03.004",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(text.parse_subtitle_time(F.col("t"))).collect()] == [3723004, 123004, None, None]
    ms = spark.createDataFrame([(3723004,), (0,), (360_000_000,)], "m long")
    assert [r[0] for r in ms.select(text.format_subtitle_time(F.col("m"))).collect()] == ["01:02:03.004", "00:00:00.000", "100:00:00.000"]
    flags = spark.createDataFrame([("YES",), ("no",), (None,)], "f string")
    assert [r[0] for r in flags.select(text.yes_no(F.col("f"))).collect()] == [True, False, False]
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([("maybe",)], "f string").select(text.yes_no(F.col("f"))).collect()
    codecs = spark.createDataFrame([("pcm-s24be",), ("ulaw",), ("pcm-f32",), ("aac",)], "c string").select(audio.pcm_codec(F.col("c")).alias("p")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in codecs] == [("signed", 3, False, 0), ("ulaw", 1, True, 255), ("float", 4, True, 0), None]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40

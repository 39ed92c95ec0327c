"""Streams: replay of a live playlist, windows with late rows, reordering."""

import pytest

from tidemark.streaming import live

HEAD = "#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:{}\n"


def playlist(path, first, names):
    path.write_text(HEAD.format(first) + "".join(f"#EXTINF:2,\n{n}\n" for n in names))


def test_a_batch_can_be_read_again_after_its_segments_have_left(tmp_path):
    path = tmp_path / "p.m3u8"
    playlist(path, 5, "abc")
    kept = live._PlaylistReader({"path": str(path), "store": f"{tmp_path}/store", "max_segments": "2"})
    rows, end = kept.read(kept.initialOffset())
    assert [r[1] for r in rows] == [5, 6] and end == {"next": 7}
    rows, last = kept.read(end)
    assert [r[1] for r in rows] == [7] and last == {"next": 8} and kept.read(last)[1] == last
    playlist(path, 9, "de")
    assert [r[1] for r in kept.readBetweenOffsets({"next": 0}, {"next": 7})] == [5, 6]
    assert [r[1] for r in kept.readBetweenOffsets({"next": 7}, {"next": 8})] == [7]
    assert list(kept.readBetweenOffsets({"next": 8}, {"next": 8})) == []
    bare = live._PlaylistReader({"path": str(path)})
    assert [r[1] for r in bare.readBetweenOffsets({"next": 9}, {"next": 11})] == [9, 10]
    with pytest.raises(ValueError, match="have left"):
        bare.readBetweenOffsets({"next": 7}, {"next": 10})


def run(df, path, mode="append"):
    """Runs a stream over what is there into memory; returns the rows of every batch."""
    out = []
    df.writeStream.foreachBatch(lambda batch, _: out.extend(batch.collect())).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return out


def test_late_rows_are_counted(spark, tmp_path):
    schema = "track long, ts timestamp, bytes long, key boolean"
    (tmp_path / "in").mkdir()

    def put(*rows):
        spark.createDataFrame([(1, t, b, True) for t, b in rows], "track long, t string, bytes long, key boolean").selectExpr("track", "cast(t as timestamp) as ts", "bytes", "key").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    stream = live.windowed_stats(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["track"], "10 seconds")
    put(("2024-01-01 00:00:01", 5), ("2024-01-01 00:01:00", 7))
    run(stream, f"{tmp_path}/c", "update")
    put(("2024-01-01 00:00:03", 6))  # long after its window was first told
    late = run(stream, f"{tmp_path}/c", "update")
    assert [(r["packets"], r["bytes"], r["keys"]) for r in late] == [(2, 11, 2)]
    slid = live.windowed_stats(spark.read.schema(schema).parquet(f"{tmp_path}/in"), ["track"], "10 seconds", slide="5 seconds")
    assert sum(r["packets"] for r in slid.collect()) == 6


def test_reordering(spark, tmp_path):
    order = [0, 3, 1, 2]
    rows = [(t, i, (i // 4 * 4 + order[i % 4]) * 40, i, i % 8 == 0) for t in (1, 2) for i in range(40)]
    schema = "track long, seq long, us long, bytes long, key boolean"
    (tmp_path / "in").mkdir()
    stream = live.reorder(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), depth=4)
    got = []
    for part in (rows[:20] + rows[40:50], rows[20:40] + rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got += run(stream, f"{tmp_path}/c")
    for t in (1, 2):
        mine = sorted((r for r in got if r["track"] == t), key=lambda r: r["place"])
        assert [r["us"] for r in mine] == [40 * k for k in range(36)] and [r["place"] for r in mine] == list(range(36))

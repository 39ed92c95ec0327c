"""Files read by range."""

import io

import pytest
from pyspark.sql import functions as F

from tidemark.sources import isobmff, media, ranged

from test_sources import av_tracks, wav


def test_only_what_is_asked_for_is_read():
    tracks, payloads = av_tracks()
    payloads[1][0] += bytes(8_000_000)
    data = isobmff.build(tracks, payloads)
    r = ranged.Ranged(io.BytesIO(data), len(data), block=4096)
    found = isobmff.parse(r)
    assert [len(t.packets) for t in found.tracks] == [len(t.packets) for t in tracks] and r.read_bytes < 200_000
    p = found.tracks[1].packets[3]
    assert r[p.offset : p.offset + p.length] == payloads[2][3]
    assert r[5] == data[5] and r[-1] == data[-1] and r[10:5] == b"" and r[0 : len(data)] == data and r[4000:9000] == data[4000:9000]
    with pytest.raises(IndexError):
        r[len(data)]


def test_the_same_rows_as_from_whole_files(spark, tmp_path):
    tracks, payloads = av_tracks()
    (tmp_path / "a.mp4").write_bytes(isobmff.build(tracks, payloads, {"title": "t"}))
    (tmp_path / "b.wav").write_bytes(wav())
    (tmp_path / "c.txt").write_bytes(b"no media")
    files, whole = ranged.listing(spark, str(tmp_path)), media.files(spark, str(tmp_path))
    assert files.columns == ["file_id", "length"] and files.count() == 3

    def rows(df):
        return sorted(df.collect(), key=str)

    assert rows(ranged.tracks(files, errors="skip")) == rows(media.tracks(whole, errors="skip"))
    assert rows(ranged.tags(files, errors="skip")) == rows(media.tags(whole, errors="skip"))
    assert rows(ranged.packets(files, data=True, errors="skip")) == rows(media.packets(whole, errors="skip"))
    part = ranged.packets(files, data=True, start=0.2, end=0.4, errors="skip")
    assert rows(part) == rows(media.packets(whole, errors="skip").filter((F.col("timestamp") >= 0.2) & (F.col("timestamp") < 0.4)))
    with pytest.raises(Exception, match="unknown format"):
        ranged.tracks(files).collect()

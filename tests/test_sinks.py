"""Tables to files and back."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import hls, isobmff, media, mpeg_audio, sinks

from test_sources import av_tracks, mp3_frame, wav


@pytest.mark.parametrize("target", ["mp4", "mkv", "mpegts"])
def test_remuxing_in_spark(spark, tmp_path, target):
    tracks, payloads = av_tracks()
    for name in "ab":
        (tmp_path / f"{name}.mp4").write_bytes(isobmff.build(tracks, payloads))
    files = media.files(spark, str(tmp_path))
    out = sinks.write_media(media.tracks(files), media.packets(files), target)
    named = out.withColumn("name", F.concat(F.regexp_extract("file_id", r"([ab])\.mp4$", 1), F.lit(f".{target}")))
    saved = sinks.save_files(named, f"{tmp_path}/out").collect()
    assert len(saved) == 2
    again = media.files(spark, f"{tmp_path}/out")
    rows = media.packets(again).collect()
    for name in "ab":
        for t in (1, 2):
            mine = sorted((r for r in rows if r["file_id"].endswith(f"{name}.{target}") and r["track_id"] == t), key=lambda r: r["seq"])
            assert [bytes(r["data"]) for r in mine] == payloads[t]
    video = media.tracks(again).filter("type = 'video'").first()
    assert video["codec"] == "avc"


def test_single_track_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(1, 8000, 2, 3000))
    files = media.files(spark, str(tmp_path))
    out = sinks.write_media(media.tracks(files), media.packets(files), "wav").first()
    assert bytes(out["content"])[44:] == wav(1, 8000, 2, 3000)[44:]
    with pytest.raises(Exception, match="one track"):
        tracks, payloads = av_tracks()
        sinks.mux("wav", tracks, payloads)


def test_mp3_flac_and_ogg_writers():
    frames = [mp3_frame(fill=i) for i in range(3)]
    m = media.parse(sinks.build_mp3(frames, {"title": "x"}))
    assert len(m.tracks[0].packets) == 3 and m.tags == {"title": "x"}
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 576).to_bytes(8, "big") + bytes(16)
    body = [sinks.flac_frame(i, 1, bytes([i]) * 50) for i in range(3)]
    data = sinks.build_flac(info, body, {"artist": "y"})
    m = media.parse(data)
    assert m.tags == {"artist": "y"} and [data[p.offset : p.offset + p.length] for p in m.tracks[0].packets] == body
    again = sinks.build_flac(m.tracks[0].description, body, {"artist": "z"})
    assert media.parse(again).tags == {"artist": "z"}
    t = av_tracks()[0][1]
    with pytest.raises(Exception, match="no writer"):
        sinks.mux("what", [t], {2: []})
    assert mpeg_audio.is_adts(sinks.mux("adts", [t], {2: [b"abc", b"de"]}))


def test_master_playlist_round_trip():
    text = sinks.master_playlist([{"path": "v.m3u8", "bandwidth": 5, "codecs": ["avc1.4d"], "width": 2, "height": 4, "frame_rate": 29.97, "audio": "a"}], [{"type": "audio", "group_id": "a", "name": "n", "language": "en", "path": "a.m3u8", "default": True}])
    variants, renditions = hls.parse_master_playlist("m.m3u8", text)
    assert (variants[0]["bandwidth"], variants[0]["width"], variants[0]["frame_rate"], variants[0]["audio"]) == (5, 2, 29.97, "a") and renditions[0]["default"]

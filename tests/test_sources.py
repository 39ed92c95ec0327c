"""Containers: files built by independent code or by our writers, read back."""

import io
import struct
import wave

import pytest

from tidemark.sources import checksums, flac_file, hls, isobmff, matroska, media, mpeg_audio, mpegts, ogg_file, tags, wave_file, webvtt
from tidemark.sources.model import MediaError, Packet, Track


def wav(channels=2, rate=48000, width=2, frames=5000):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(i % 251 for i in range(frames * channels * width)))
    return buffer.getvalue()


@pytest.mark.parametrize(("channels", "width", "codec"), [(1, 1, "pcm-u8"), (2, 2, "pcm-s16"), (6, 3, "pcm-s24"), (2, 4, "pcm-s32")])
def test_wave_of_the_standard_library(channels, width, codec):
    data = wav(channels, 44100, width, 5000)
    m = media.parse(data)
    t = m.tracks[0]
    assert (m.format, t.codec, t.channels, t.sample_rate, t.duration_ticks) == ("wav", codec, channels, 44100, 5000)
    assert [(p.ticks, p.duration_ticks) for p in t.packets] == [(0, 2048), (2048, 2048), (4096, 904)]
    assert b"".join(data[p.offset : p.offset + p.length] for p in t.packets) == data[44:]


def test_wave_round_trip_with_tags():
    data = wave_file.build("pcm-s16", 1, 8000, b"\1\2" * 30, {"title": "Söng", "artist": "A", "genre": "g"})
    m = media.parse(data)
    assert m.tags == {"title": "Söng", "artist": "A", "genre": "g"}
    assert m.tracks[0].duration_ticks == 30
    with wave.open(io.BytesIO(data)) as w:
        assert w.getnframes() == 30


def mp3_frame(bitrate_index=9, rate_index=0, fill=7):
    head = bytes([0xFF, 0xFB, bitrate_index << 4 | rate_index << 2, 0])
    size = mpeg_audio.mp3_header(head, 0)["size"]
    return head + bytes([fill]) * (size - 4)


def test_mp3_frames_and_tags():
    data = tags.build_id3v2({"title": "T", "track": "3/12", "comment": "c"}) + mp3_frame() * 4
    m = media.parse(data)
    assert m.format == "mp3" and len(m.tracks[0].packets) == 4
    assert m.tracks[0].packets[1].duration_ticks == 1152 and m.tracks[0].packets[0].length == 417
    assert tags.normalised(m.tags) == {"title": "T", "track_no": "3", "tracks_total": "12", "comment": "c"}


def test_adts_round_trip():
    config = mpeg_audio.audio_specific_config(2, 44100, 2)
    assert config == bytes([0x12, 0x10])
    body = [bytes([i]) * (10 + i) for i in range(5)]
    m = media.parse(mpeg_audio.build_adts(body, config))
    t = m.tracks[0]
    assert (m.format, t.codec_string, t.sample_rate, t.channels, t.description) == ("adts", "mp4a.40.2", 44100, 2, config)
    assert [p.length for p in t.packets] == [10, 11, 12, 13, 14] and t.packets[4].ticks == 4096


def test_flac_frames():
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 8192).to_bytes(8, "big") + bytes(16)
    head = b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info
    comments = tags.build_vorbis_comments({"title": "x", "artist": "y"})
    head += b"\x84" + len(comments).to_bytes(3, "big") + comments
    out = head
    for i in range(2):
        h = bytes([0xFF, 0xF8, 0xC9, 0x18, i])
        h += bytes([checksums.crc8(h)])
        body = h + b"\xff\xf8 not a header" + bytes(40)
        out += body + struct.pack(">H", checksums.crc16(body))
    m = media.parse(out)
    assert m.tags == {"title": "x", "artist": "y"}
    assert [(p.ticks, p.duration_ticks) for p in m.tracks[0].packets] == [(0, 4096), (4096, 4096)]
    assert sum(p.length for p in m.tracks[0].packets) == len(out) - len(head)


def test_ogg_opus_round_trip():
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 48000, 0, 0)
    info = b"OpusTags" + tags.build_vorbis_comments({"title": "t"})
    body = [bytes([0xFC]) + bytes([i]) * n for i, n in enumerate((10, 254, 255, 600, 70_000))]
    data = ogg_file.build([head, info], [(b, 960 * (i + 1)) for i, b in enumerate(body)])
    m = media.parse(data)
    t = m.tracks[0]
    assert (m.format, t.codec, t.channels, m.tags) == ("ogg", "opus", 2, {"title": "t"})
    assert [p.ticks for p in t.packets] == [-312 + 960 * i for i in range(5)]
    assert [p.data if p.data is not None else data[p.offset : p.offset + p.length] for p in t.packets] == body


def test_checksums():
    assert checksums.mpeg_crc(b"123456789") == 0x0376E6E7
    assert checksums.crc8(b"123456789") == 0xF4
    assert checksums.crc16(b"123456789") == 0xFEE8


def av_tracks():
    order = [0, 3, 1, 2]  # decode order of each four frames
    video = Track(1, "video", "avc", 25.0, width=320, height=240, description=b"\1\x64\0\x1f")
    for i in range(24):
        video.packets.append(Packet(i, i // 4 * 4 + order[i % 4], 1, 0, 0, i % 12 == 0))
    audio = Track(2, "audio", "aac", 48000.0, channels=2, sample_rate=48000, description=mpeg_audio.audio_specific_config(2, 48000, 2), language="deu")
    for i in range(40):
        audio.packets.append(Packet(i, i * 1024, 1024, 0, 0))
    payloads = {1: [b"\0\0\1" + (b"\x65" if p.key else b"\x41") + bytes([p.seq]) * (20 + p.seq) for p in video.packets], 2: [bytes([255 - p.seq]) * (5 + p.seq) for p in audio.packets]}
    return [video, audio], payloads


def bodies(m, data):
    return {t.track_id: [p.data if p.data is not None else data[p.offset : p.offset + p.length] for p in t.packets] for t in m.tracks}


def test_mp4_round_trip():
    tracks, payloads = av_tracks()
    data = isobmff.build(tracks, payloads, {"title": "film", "artist": "me"})
    m = media.parse(data)
    assert m.format == "mp4" and m.tags == {"title": "film", "artist": "me"}
    assert bodies(m, data) == payloads
    v, a = m.tracks
    assert [p.ticks for p in v.packets] == [p.ticks for p in tracks[0].packets] and [p.key for p in v.packets] == [p.key for p in tracks[0].packets]
    assert (v.codec, v.width, v.height, v.codec_string) == ("avc", 320, 240, "avc1.64001f")
    assert (a.codec, a.channels, a.sample_rate, a.language, a.codec_string) == ("aac", 2, 48000, "deu", "mp4a.40.2")


def test_mp4_fragments():
    tracks, payloads = av_tracks()
    whole = isobmff.build(tracks[1:], {2: []} | {2: payloads[2]})
    moov = isobmff.find(whole, 0, len(whole), b"moov")
    empty = isobmff.build([Track(2, "audio", "aac", 48000.0, channels=2, sample_rate=48000, description=tracks[1].description)], {2: []})
    box = isobmff._box
    trex = isobmff._full(b"trex", struct.pack(">5I", 2, 1, 1024, 0, 0))
    m2 = isobmff.find(empty, 0, len(empty), b"moov")
    head = empty[: m2[0] - 8] + box(b"moov", empty[m2[0] : m2[1]], box(b"mvex", trex))
    out = head
    for k in range(2):
        part = payloads[2][k * 3 : k * 3 + 3]

        def moof(offset, part=part, k=k):
            run = isobmff._full(b"trun", struct.pack(">Ii", 3, offset), *[struct.pack(">I", len(x)) for x in part], flags=0x201)
            return box(b"moof", isobmff._full(b"mfhd", struct.pack(">I", k)), box(b"traf", isobmff._full(b"tfhd", struct.pack(">I", 2), flags=0x20000), isobmff._full(b"tfdt", struct.pack(">I", k * 3072)), run))

        out += moof(len(moof(0)) + 8) + box(b"mdat", *part)
    m = media.parse(out)
    assert moov and bodies(m, out)[2] == payloads[2][:6]
    assert [p.ticks for p in m.tracks[0].packets] == [i * 1024 for i in range(6)]


def test_matroska_round_trip():
    tracks, payloads = av_tracks()
    data = matroska.build(tracks, payloads, {"title": "film", "genre": "g"})
    m = media.parse(data)
    assert m.format == "mkv" and m.tags == {"title": "film", "genre": "g"}
    assert bodies(m, data) == payloads
    assert [p.ticks for p in m.tracks[0].packets] == [p.ticks * 40 for p in tracks[0].packets]
    assert [p.key for p in m.tracks[0].packets] == [p.key for p in tracks[0].packets]
    assert m.tracks[1].language == "deu" and m.tracks[1].sample_rate == 48000


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_matroska_lacing(kind):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if kind == 2 else [b"a" * 300, b"b" * 5, b"c" * 270]
    if kind == 1:
        sizes = b"\xff\x2d" + b"\x05"
    elif kind == 2:
        sizes = b""
    else:
        sizes = struct.pack(">H", 0x4000 | 300) + struct.pack(">H", 0x4000 | (5 - 300 + 8191))
    body = bytes([2]) + sizes + b"".join(frames)
    assert [body[a : a + n] for a, n in matroska._laced(body, 0, len(body), kind)] == frames


def test_mpegts_round_trip():
    tracks, payloads = av_tracks()
    adts = {1: payloads[1], 2: [mpeg_audio.build_adts([b], tracks[1].description) for b in payloads[2]]}
    data = mpegts.build(tracks, adts)
    assert len(data) % 188 == 0
    m = media.parse(data)
    assert m.format == "mpegts" and bodies(m, data) == payloads
    assert [p.ticks for p in m.tracks[0].packets] == [p.ticks * 3600 for p in tracks[0].packets]
    assert [p.key for p in m.tracks[0].packets] == [p.key for p in tracks[0].packets]
    assert m.tracks[1].sample_rate == 48000


def test_unknown_and_broken():
    assert media.detect(b"") is None and media.detect(b"hello there") is None
    with pytest.raises(MediaError):
        media.parse(b"nothing known")
    with pytest.raises(MediaError):
        media.parse(b"RIFF\0\0\0\0WAVE")


def test_empty_media():
    t = Track(1, "audio", "aac", 48000.0, channels=2, sample_rate=48000, description=mpeg_audio.audio_specific_config(2, 48000, 2))
    for build in (isobmff.build, matroska.build):
        m = media.parse(build([t], {1: []}))
        assert len(m.tracks) == 1 and not m.tracks[0].packets


def test_tables_in_spark(spark, tmp_path):
    tracks, payloads = av_tracks()
    (tmp_path / "a.mp4").write_bytes(isobmff.build(tracks, payloads, {"title": "x", "album": "y"}))
    (tmp_path / "b.mkv").write_bytes(matroska.build(tracks, payloads))
    (tmp_path / "c.wav").write_bytes(wav())
    (tmp_path / "d.txt").write_bytes(b"text")
    rows = media.files(spark, str(tmp_path))
    t = media.tracks(rows, errors="skip")
    assert {(r["format"], r["type"], r["codec"]) for r in t.collect()} == {("mp4", "video", "avc"), ("mp4", "audio", "aac"), ("mkv", "video", "avc"), ("mkv", "audio", "aac"), ("wav", "audio", "pcm-s16")}
    p = media.packets(rows, errors="skip")
    assert p.count() == 2 * (24 + 40) + 3
    assert {bytes(r["data"]) for r in p.filter("track_id = 2 and file_id like '%a.mp4'").collect()} == set(payloads[2])
    assert media.packets(rows, data=False, errors="skip").filter("data is not null").count() == 0
    assert media.tags(rows, errors="skip").filter("title = 'x'").first()["album"] == "y"
    with pytest.raises(Exception, match="unknown format"):
        media.tracks(rows).collect()


def test_webvtt_round_trip(spark):
    text = "WEBVTT\n\n1\n00:00.000 --> 00:00.900 align:start\nHello\nyou\n\nNOTE x\n\n00:01.000 --> 00:01.400\nb\n\n01:00:01.500 --> 01:00:02.900\nc"
    cues = webvtt.parse(text)[1]
    assert [(c["timestamp"], round(c["duration"], 3), c["text"], c["identifier"]) for c in cues] == [(0.0, 0.9, "Hello\nyou", "1"), (1.0, 0.4, "b", None), (3601.5, 1.4, "c", None)]
    assert cues[0]["settings"] == "align:start" and cues[1]["notes"] == "NOTE x\n\n"
    files = spark.createDataFrame([("f", text), ("g", "WEBVTT\n\n")], "path string, text string")
    rows = webvtt.read_cues(files)
    again = webvtt.write_cues(rows).first()["text"]
    assert [(c["timestamp"], c["text"]) for c in webvtt.parse(again)[1]] == [(c["timestamp"], c["text"]) for c in cues]
    with pytest.raises(ValueError):
        webvtt.parse("no preamble")


def test_media_playlist():
    text = """#EXTM3U
#EXT-X-TARGETDURATION:4
#EXT-X-MEDIA-SEQUENCE:3
#EXT-X-KEY:METHOD=AES-128,URI="k.bin"
#EXTINF:2,
a.ts
# comment
#EXT-X-BYTERANGE:100@50
#EXTINF:1.5,title
b.ts
#EXT-X-BYTERANGE:10
#EXT-X-DISCONTINUITY
#EXT-X-KEY:METHOD=NONE
#EXTINF:0,
b.ts
#EXT-X-ENDLIST
#EXTINF:9,
never.ts"""
    s = hls.parse_media_playlist("http://h/x/list.m3u8?q=1", text)
    assert [(x["seq_no"], x["start"], x["duration"], x["path"], x["byte_offset"], x["byte_length"], x["discontinuity"]) for x in s] == [
        (3, 12.0, 2.0, "http://h/x/a.ts", 0, None, 0), (4, 14.0, 1.5, "http://h/x/b.ts", 50, 100, 0), (5, 15.5, 0.0, "http://h/x/b.ts", 150, 10, 1)]
    assert s[0]["iv"] == f"{3:032x}" and s[0]["key_uri"] == "http://h/x/k.bin" and s[2]["enc_method"] is None and s[0]["ended"]


def test_playlist_dates():
    text = "#EXTM3U\n#EXTINF:2,\na\n#EXT-X-PROGRAM-DATE-TIME:1970-01-01T00:01:40Z\n#EXTINF:2,\nb\n#EXTINF:2,\nc"
    assert [x["start"] for x in hls.parse_media_playlist("p", text)] == [98.0, 100.0, 102.0]
    assert [(x["start"], x["unix_start"]) for x in hls.parse_media_playlist("p", text, False)] == [(0.0, 98.0), (2.0, 100.0), (4.0, 102.0)]
    for bad in ("", "#EXTINF:1,\na", "#EXTM3U\na.ts", "#EXTM3U\n#EXTINF:x,\na", "#EXTM3U\n#EXT-X-KEY:METHOD=ROT13\n"):
        with pytest.raises(hls.PlaylistError):
            hls.parse_media_playlist("p", bad)


def test_master_playlist():
    text = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="en, us",DEFAULT=YES,URI="a.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=100,CODECS="avc1.4d,mp4a.40.2",RESOLUTION=64x48,AUDIO="a"\nv.m3u8\n#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=5,URI="i.m3u8"'
    variants, renditions = hls.parse_master_playlist("http://h/m.m3u8", text)
    assert [(v["path"], v["bandwidth"], v["only_key"], v["width"]) for v in variants] == [("http://h/v.m3u8", 100, False, 64), ("http://h/i.m3u8", 5, True, None)]
    assert variants[0]["codecs"] == ["avc1.4d", "mp4a.40.2"] and renditions[0]["name"] == "en, us" and renditions[0]["default"]
    assert flac_file.is_flac(b"fLaC")

"""Fragments, protection, damage, attachments."""

import zlib

import pytest

from tidemark.functions import encryption
from tidemark.sources import hls, isobmff, matroska, media, mpeg_audio, mpegts, sinks, tags
from tidemark.sources.model import MediaError

from test_sources import av_tracks, bodies, mp3_frame


def test_fragmented_files():
    tracks, payloads = av_tracks()
    data = sinks.mux("cmaf", tracks, payloads, {"title": "t"})
    m = media.parse(data)
    assert bodies(m, data) == payloads and m.tags == {"title": "t"}
    for got, made in zip(m.tracks, tracks, strict=True):
        assert [(p.ticks, p.key) for p in got.packets] == [(p.ticks, p.key) for p in made.packets]
    parts = isobmff.fragments(tracks, payloads, 0.4)
    assert len(parts) == 2 and isobmff.fragments([], {}) == []
    segment = parts[1]
    found = isobmff.with_initialisation(isobmff.initialisation(tracks), segment)
    video = found.tracks[0]
    assert [segment[p.offset : p.offset + p.length] for p in video.packets] == payloads[1][12:] and video.packets[0].key
    with pytest.raises(MediaError):
        isobmff.with_initialisation(b"", segment)
    head = isobmff.find(isobmff.build(tracks, payloads), 0, 10**6, b"moov")
    assert head[1] - head[0] <= isobmff.size_bound(tracks)


def test_protection_boxes():
    ids = ["00" * 15 + "01", "ab" * 16]
    box = isobmff.build_protection("ed" * 16, ids, b"xyz")
    assert isobmff.parse_protection(box[8:]) == {"version": 1, "system_id": "ed" * 16, "key_ids": ids, "data": b"xyz".hex()}
    data = isobmff._box(b"ftyp", b"isom") + isobmff._box(b"moov", isobmff.build_protection("01" * 16, [], b""), box)
    assert [p["system_id"] for p in isobmff.protection(data)] == ["01" * 16, "ed" * 16]
    with pytest.raises(MediaError):
        isobmff.parse_protection(box[8:-1])



def test_matroska_after_damage():
    tracks, payloads = av_tracks()
    data = matroska.build(tracks, payloads, cluster_ms=200)
    places = [i for i in range(len(data)) if data.startswith(b"\x1f\x43\xb6\x75", i)]
    assert len(places) == 2
    broken = bytearray(data)
    broken[places[0]] = 0x77  # the first cluster can't be told any more
    whole, rest = matroska.parse(data), matroska.parse(bytes(broken))
    lost = {p.ticks for p in whole.tracks[0].packets} - {p.ticks for p in rest.tracks[0].packets}
    assert lost and rest.tracks[0].packets[-1].ticks == whole.tracks[0].packets[-1].ticks


@pytest.mark.parametrize("method", [0, 3])
def test_matroska_compression(method):
    tracks, payloads = av_tracks()
    start = b"\x2a\x2b"
    stored = [zlib.compress(p) if method == 0 else p for p in payloads[2]]
    made = matroska.build(tracks[1:], {2: stored})
    inner = matroska._element(0x6D80, matroska._element(0x6240, matroska._element(0x5034, matroska._int(0x4254, method) + (matroska._element(0x4255, start) if method else b""))))
    seg = next((a, b) for n, a, b in matroska.elements(made, 0, len(made)) if n == 0x18538067)
    out = b""
    for n, a, b in matroska.elements(made, *seg):
        body = made[a:b]
        if n == 0x1654AE6B:
            x = next((p, q) for m, p, q in matroska.elements(made, a, b) if m == 0xAE)
            body = matroska._element(0xAE, made[x[0] : x[1]] + inner)
        out += matroska._element(n, body)
    m = matroska.parse(matroska._element(0x1A45DFA3, b"") + matroska._element(0x18538067, out))
    want = payloads[2] if method == 0 else [start + p for p in payloads[2]]
    assert [p.data for p in m.tracks[0].packets] == want and m.tracks[0].packets[0].length == len(want[0])


def test_transport_streams_with_longer_packets():
    tracks, payloads = av_tracks()
    plain = sinks.mux("mpegts", tracks, payloads)
    cut = [plain[i : i + 188] for i in range(0, len(plain), 188)]
    want = bodies(mpegts.parse(plain), plain)
    for data in (b"".join(b"\1\2\3\4" + c for c in cut), b"".join(c + bytes(16) for c in cut)):
        assert media.detect(data) == "mpegts" and bodies(mpegts.parse(data), data) == want


def test_mp3_after_junk_and_with_a_count():
    frames = [mp3_frame(fill=i) for i in range(4)]
    assert mpeg_audio.is_mp3(bytes(100) + b"".join(frames)) and not mpeg_audio.is_mp3(bytes(5000) + b"".join(frames)) and not mpeg_audio.is_mp3(bytes(300))
    data = sinks.build_mp3(frames)
    m = media.parse(data)
    assert len(m.tracks[0].packets) == 4 and m.tracks[0].duration_ticks == 4 * 1152
    cut = data[: -len(frames[0])]  # the file was cut, the count still tells
    assert media.parse(cut).tracks[0].duration_ticks == 4 * 1152


def test_attachments_and_validation():
    image = tags.AttachedImage(b"\x89PNG...", "image/png", "front", description="cövër")
    frame = tags.id3v2_image(image)
    data = b"ID3\x04\0\0" + tags.to_synchsafe(len(frame)) + frame + mp3_frame()
    assert tags.id3v2_images(data) == [image] and tags.id3v2_images(b"") == []
    assert tags.flac_picture(tags.build_flac_picture(image)) == image
    tags.validate({"title": "x", "track_no": 1, "tracks_total": 3, "images": [image], "raw": {"a": "b"}})
    for bad in ({"title": 3}, {"track_no": 0}, {"disc_no": True}, {"images": ["x"]}, {"raw": {"a": 1}}):
        with pytest.raises(TypeError):
            tags.validate(bad)
    with pytest.raises(ValueError):
        tags.validate({"track_no": 4, "tracks_total": 3})
    assert tags.are_empty({"title": None, "raw": {}}) and not tags.are_empty({"title": "x"})


KEY = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
PLAIN = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710")
CTR = bytes.fromhex("874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff5ae4df3edbd5d35e5b4f09020db03eab1e031dda2fbe03d1792170a0f3009cee")
CBC = bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b273bed6b8e3c1743b7116e69e222295163ff1caa1681fac09120eca307586e1a7")
SAMPLE = "data binary, key binary, iv binary, parts array<struct<clear: int, protected: int>>"


def test_decryption_by_published_vectors(spark):
    iv = bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    rows = [(CTR, KEY, iv, None), (b"head" + CTR[:20] + b"mid" + CTR[20:], KEY, iv, [(4, 20), (3, 44)]), (b"", KEY, iv, None)]
    got = [bytes(r["clear"]) for r in encryption.decrypt_ctr(spark.createDataFrame(rows, SAMPLE).coalesce(1)).collect()]
    assert got == [PLAIN, b"head" + PLAIN[:20] + b"mid" + PLAIN[20:], b""]
    zero = bytes(range(16))
    rows = [(CBC + b"tail", KEY, zero, None), (b"ab" + CBC[:32] + b"rest", KEY, zero, [(2, 36)])]
    got = [bytes(r["clear"]) for r in encryption.decrypt_cbcs(spark.createDataFrame(rows, SAMPLE).coalesce(1), skip=0).collect()]
    assert got == [PLAIN + b"tail", b"ab" + PLAIN[:32] + b"rest"]
    # One block of three: the chain runs over the blocks that are encrypted.
    mixed = CBC[:16] + b"x" * 32 + CBC[16:32] + b"y" * 20
    got = encryption.decrypt_cbcs(spark.createDataFrame([(mixed, KEY, zero, None)], SAMPLE), 1, 2).first()["clear"]
    assert bytes(got) == PLAIN[:16] + b"x" * 32 + PLAIN[16:32] + b"y" * 20


def test_neighbouring_segments(spark):
    rows = spark.createDataFrame([("p", 3), ("p", 4), ("p", 7), ("q", 1)], "playlist string, seq_no long")
    got = {(r["playlist"], r["seq_no"]): (r["previous_seq"], r["next_seq"]) for r in hls.neighbours(rows).collect()}
    assert got == {("p", 3): (None, 4), ("p", 4): (3, 7), ("p", 7): (4, None), ("q", 1): (None, None)}

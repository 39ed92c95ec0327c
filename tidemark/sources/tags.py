"""Metadata tags: ID3v1 and v2, Vorbis comments, RIFF INFO, to common names."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Names in each system and the common name.
ID3 = {"TIT2": "title", "TIT3": "description", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TRCK": "track", "TPOS": "disc", "TCON": "genre", "TDRC": "date", "TYER": "date", "COMM": "comment", "USLT": "lyrics", "TT2": "title", "TP1": "artist", "TAL": "album", "TP2": "album_artist", "TRK": "track", "TPA": "disc", "TCO": "genre", "TYE": "date", "COM": "comment", "ULT": "lyrics"}
VORBIS = {"title": "title", "description": "description", "artist": "artist", "album": "album", "albumartist": "album_artist", "tracknumber": "track", "tracktotal": "tracks_total", "discnumber": "disc", "disctotal": "discs_total", "date": "date", "genre": "genre", "comment": "comment", "lyrics": "lyrics"}
RIFF = {"INAM": "title", "TITL": "title", "IART": "artist", "IPRD": "album", "IPRT": "track", "ITRK": "track", "TRCK": "track", "ICRD": "date", "IGNR": "genre", "ICMT": "comment", "CMNT": "comment", "COMM": "comment", "TIT3": "description"}


def synchsafe(data: bytes) -> int:
    """Seven bits of each byte."""
    n = 0
    for b in data:
        n = n << 7 | b & 0x7F
    return n


def to_synchsafe(n: int, size: int = 4) -> bytes:
    return bytes((n >> 7 * i) & 0x7F for i in reversed(range(size)))


def _text(data: bytes) -> str:
    if not data:
        return ""
    kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(data[0], 3)]
    return data[1:].decode(kind, "replace")


def id3v2_size(data: bytes, at: int = 0) -> int:
    """Bytes of the tag at this place; 0 without one."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return 0
    return 10 + synchsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 0x10 else 0)


def id3v2(data: bytes) -> dict[str, str]:
    size = id3v2_size(data)
    if not size:
        return {}
    version, flags = data[3], data[5]
    body = data[10:size]
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3:
        at = 4 + struct.unpack(">I", body[:4])[0] if version == 3 else synchsafe(body[:4])
    name_size, head = (3, 6) if version == 2 else (4, 10)
    out: dict[str, str] = {}
    while at + head <= len(body) and body[at]:
        name = body[at : at + name_size].decode("latin-1")
        raw = body[at + name_size : at + name_size + (3 if version == 2 else 4)]
        n = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + n]
        at += head + n
        key = ID3.get(name)
        if key and value:
            if key in ("comment", "lyrics"):  # a language and a short description come first
                wide = value[0] in (1, 2)
                end = value.find(b"\0\0", 4) if wide else value.find(b"\0", 4)
                value = value[:1] + value[end + (2 if wide else 1) :] if end >= 0 else value[:1]
            text = _text(value).split("\0")[0].strip("﻿\0")
            if text:
                out.setdefault(key, text)
    return out


def id3v1(data: bytes) -> dict[str, str]:
    tag = data[-128:]
    if tag[:3] != b"TAG" or len(tag) < 128:
        return {}
    field = lambda a, n: tag[a : a + n].split(b"\0")[0].decode("latin-1").strip()
    out = {"title": field(3, 30), "artist": field(33, 30), "album": field(63, 30), "date": field(93, 4), "comment": field(97, 28)}
    if not tag[125] and tag[126]:
        out["track"] = str(tag[126])
    return {k: v for k, v in out.items() if v}


def build_id3v2(tags: dict[str, str]) -> bytes:
    """A version 2.4 tag in UTF-8."""
    names = {}
    for name, key in ID3.items():
        if len(name) == 4 and name != "TYER":
            names.setdefault(key, name)
    body = b""
    for key, value in tags.items():
        if key in names:
            inner = b"\x03" + (b"und\0" if key in ("comment", "lyrics") else b"") + value.encode()
            body += names[key].encode() + to_synchsafe(len(inner)) + b"\0\0" + inner
    return b"ID3\x04\0\0" + to_synchsafe(len(body)) + body


def vorbis_comments(data: bytes) -> dict[str, str]:
    """Tags of a comment block that begins with the vendor's length."""
    out: dict[str, str] = {}
    vendor = struct.unpack_from("<I", data)[0]
    at = 4 + vendor
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(n):
        if at + 4 > len(data):
            break
        (size,) = struct.unpack_from("<I", data, at)
        name, eq, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        if eq:
            out.setdefault(VORBIS.get(name.lower(), name.lower()), value)
    return out


def build_vorbis_comments(tags: dict[str, str], vendor: str = "tidemark") -> bytes:
    names = {v: k for k, v in VORBIS.items()}
    entries = [f"{names.get(k, k).upper()}={v}".encode() for k, v in tags.items()]
    return struct.pack("<I", len(vendor)) + vendor.encode() + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in entries)


def normalised(tags: dict[str, str]) -> dict[str, str]:
    """Splits "3/12" into a number and a total."""
    out = dict(tags)
    for key, number, total in (("track", "track_no", "tracks_total"), ("disc", "disc_no", "discs_total")):
        if key in out:
            a, _, b = out.pop(key).partition("/")
            if a.strip().isdigit():
                out.setdefault(number, a.strip())
            if b.strip().isdigit():
                out.setdefault(total, b.strip())
    return out


NUMBERS = ("track_no", "tracks_total", "disc_no", "discs_total")
TEXTS = ("title", "description", "artist", "album", "album_artist", "genre", "lyrics", "comment", "date")
IMAGE_KINDS = ("front", "back", "other")


@dataclass(frozen=True)
class AttachedImage:
    """A picture that goes with a file."""

    data: bytes
    mime_type: str
    kind: str = "other"
    name: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class AttachedFile:
    """Any other file that goes with one."""

    data: bytes
    mime_type: str | None = None
    name: str | None = None
    description: str | None = None


def validate(tags: dict) -> None:
    """Raises an error for tags that no file can hold as they are: wrong types, numbers below 1, a number beyond its total."""
    for key in TEXTS:
        if tags.get(key) is not None and not isinstance(tags[key], str):
            raise TypeError(f"{key} must be text")
    for key in NUMBERS:
        value = tags.get(key)
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
            raise TypeError(f"{key} must be a whole number above 0")
    for number, total in (("track_no", "tracks_total"), ("disc_no", "discs_total")):
        if tags.get(number) and tags.get(total) and tags[number] > tags[total]:
            raise ValueError(f"{number} is beyond {total}")
    for image in tags.get("images") or ():
        if not isinstance(image, AttachedImage) or not image.data or "/" not in image.mime_type or image.kind not in IMAGE_KINDS:
            raise TypeError("images must be AttachedImage with data, a MIME type and a known kind")
    raw = tags.get("raw")
    if raw is not None and not (isinstance(raw, dict) and all(isinstance(k, str) and isinstance(v, (str, bytes, AttachedImage, AttachedFile, type(None))) for k, v in raw.items())):
        raise TypeError("raw must map names to text, bytes or attachments")


def are_empty(tags: dict) -> bool:
    """Whether no tag has a value."""
    return not any(v for k, v in tags.items() if k in TEXTS or k in NUMBERS or k in ("images", "raw"))


def id3v2_images(data: bytes) -> list[AttachedImage]:
    """The pictures of an ID3 tag of version 2.3 or 2.4."""
    size = id3v2_size(data)
    if not size or data[3] < 3:
        return []
    body, at, out = data[10:size], 0, []
    while at + 10 <= len(body) and body[at]:
        n = synchsafe(body[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        value = body[at + 10 : at + 10 + n]
        if body[at : at + 4] == b"APIC" and value:
            mime, _, rest = value[1:].partition(b"\0")
            wide = value[0] in (1, 2)
            end = next((i for i in range(1, len(rest), 2) if rest[i : i + 2] == b"\0\0"), len(rest)) if wide else rest.find(b"\0", 1)
            text = _text(value[:1] + rest[1:end])
            out.append(AttachedImage(rest[end + (2 if wide else 1) :], mime.decode("latin-1"), {3: "front", 4: "back"}.get(rest[0], "other"), description=text or None))
        at += 10 + n
    return out


def id3v2_image(image: AttachedImage) -> bytes:
    """A picture as a frame of an ID3 2.4 tag."""
    body = b"\x03" + image.mime_type.encode("latin-1") + b"\0" + bytes([{"front": 3, "back": 4}.get(image.kind, 0)]) + (image.description or "").encode() + b"\0" + image.data
    return b"APIC" + to_synchsafe(len(body)) + b"\0\0" + body


def flac_picture(block: bytes) -> AttachedImage:
    """A picture block, as FLAC and Vorbis comments hold it."""
    kind, n = struct.unpack_from(">II", block)
    mime, at = block[8 : 8 + n].decode("latin-1"), 8 + n
    (m,) = struct.unpack_from(">I", block, at)
    text, at = block[at + 4 : at + 4 + m].decode("utf-8", "replace"), at + 4 + m + 16
    (size,) = struct.unpack_from(">I", block, at)
    return AttachedImage(block[at + 4 : at + 4 + size], mime, {3: "front", 4: "back"}.get(kind, "other"), description=text or None)


def build_flac_picture(image: AttachedImage) -> bytes:
    mime, text = image.mime_type.encode("latin-1"), (image.description or "").encode()
    return struct.pack(">II", {"front": 3, "back": 4}.get(image.kind, 0), len(mime)) + mime + struct.pack(">I", len(text)) + text + bytes(16) + struct.pack(">I", len(image.data)) + image.data

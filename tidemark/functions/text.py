"""Text functions: subtitle times, paths, language codes, playlists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_subtitle_time(c: Column) -> Column:
    """A WebVTT timestamp ([hours:]mm:ss.ttt) in milliseconds; null for anything else."""
    fields = F.split(F.trim(c), "[:.]")
    number = lambda i: F.try_element_at(fields, F.lit(i)).cast("long")
    valid = F.trim(c).rlike("^([0-9]{2,}:)?[0-9]{2}:[0-9]{2}[.][0-9]{3}$")
    hours = F.when(F.size(fields) > 3, number(1)).otherwise(0)
    return F.when(valid, 3_600_000 * hours + 60_000 * number(-3) + 1000 * number(-2) + number(-1))


def format_subtitle_time(ms: Column) -> Column:
    """Milliseconds to HH:MM:SS.mmm; hours take as many digits as they need."""
    pad = lambda x, n: F.when(F.length(x.cast("string")) >= n, x.cast("string")).otherwise(F.lpad(x.cast("string"), n, "0"))
    whole = lambda x, y: F.floor(x / y).cast("long")
    return F.concat(pad(whole(ms, 3_600_000), 2), F.lit(":"), pad(whole(F.pmod(ms, F.lit(3_600_000)), 60_000), 2), F.lit(":"), pad(whole(F.pmod(ms, F.lit(60_000)), 1000), 2), F.lit("."), pad(F.pmod(ms, F.lit(1000)), 3))


def join_path(base: str, relative: str) -> str:
    """What join_paths gives for one pair of texts."""

    def host(address: str) -> str:
        scheme, mark, rest = address.partition("://")
        return scheme + mark + rest.partition("/")[0] if mark and "/" not in scheme else ""

    if "://" in relative:
        return relative
    file = base.partition("?")[0] if "://" in base else base
    whole = host(file) + relative if relative.startswith("/") else file[: file.rfind("/") + 1] + relative
    front = host(whole) if whole[len(host(whole)) :].startswith("/") else ""
    done: list[str] = []
    for part in whole[len(front) :].split("/"):
        if part == "..":
            done = done[:-1]
        elif part != ".":
            done.append(part)
    return front + "/".join(done)


def join_paths(base: Column, relative: Column) -> Column:
    """Resolves a path against the path, or the address without its query, of the file that names it."""
    address = "^([^/]*://[^/]*)"
    file = F.when(F.contains(base, F.lit("://")), F.substring_index(base, "?", 1)).otherwise(base)
    # The part after the last slash is replaced; of a bare host that slash is the scheme's.
    beside = F.concat(F.regexp_replace(file, "[^/]*$", ""), relative)
    whole = F.when(F.startswith(relative, F.lit("/")), F.concat(F.regexp_extract(file, address, 1), relative)).otherwise(beside)
    host = F.regexp_extract(whole, address + "/", 1)
    parts = F.split(F.substring(whole, F.length(host) + 1, F.length(whole)), "/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.when(F.contains(relative, F.lit("://")), relative).otherwise(F.concat(host, F.array_join(F.aggregate(parts, none, step), "/")))


def language_code(c: Column) -> Column:
    """The primary subtag of a language tag if it is a three-letter code, otherwise und."""
    first = F.element_at(F.split(F.lower(c), "-"), 1)
    return F.when(first.rlike("^[a-z]{3}$"), first).otherwise("und")


def yes_no(c: Column) -> Column:
    """YES or NO of a playlist attribute, in any case; null is NO; anything else is an error."""
    return F.when(c.isNull() | (F.upper(c) == "NO"), False).when(F.upper(c) == "YES", True).otherwise(F.raise_error(F.concat(F.lit("neither YES nor NO: "), c)).cast("boolean"))


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


#: Extensions of image types.
IMAGE_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/svg+xml": ".svg", "image/tiff": ".tiff", "image/avif": ".avif", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico"}


def image_extension(c: Column) -> Column:
    """The file name extension of an image's MIME type, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in IMAGE_EXTENSIONS.items() for x in kv]), F.lower(c))

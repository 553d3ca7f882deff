"""Paths, location URLs and file names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by class (fixed values).
EXTENSIONS = {"lossless": ("flac", "aiff", "aif", "wav"), "mp3": ("mp3",), "aac": ("m4a", "aac", "mp4")}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; empty for a name that only begins with one."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1))


def media_class(ext: Column) -> Column:
    """lossless, mp3, aac, or null for an extension that isn't supported."""
    low, made = F.lower(ext), None
    for name, extensions in EXTENSIONS.items():
        made = (F if made is None else made).when(low.isin(*extensions), F.lit(name))
    return made


def is_audio(path: Column) -> Column:
    return ~basename(path).startswith("._") & media_class(extension(path)).isNotNull()


def stem(path: Column) -> Column:
    """The name without its extension; empty if there is no name."""
    return F.regexp_extract(basename(path), r"(?s)^(.+?)(?:\.[^.]*)?$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def decode_location(url: Column) -> Column:
    """The path of a file URL; null for another URL, a broken escape or bytes that aren't UTF-8. A + stays, as a % in the last two bytes."""
    bare = F.regexp_replace(url, r"^file://(localhost)?", "")
    safe = F.regexp_replace(F.replace(bare, F.lit("+"), F.lit("%2B")), r"%(?=[\x00-\x7F]?\z)", "%25")
    path = F.try_url_decode(safe)
    wrong = F.contains(path, F.lit("�")) & ~F.contains(bare, F.lit("�")) & ~F.contains(F.upper(bare), F.lit("%EF%BF%BD"))
    return F.when(url.startswith("file://") & ~wrong, F.regexp_replace(path, r"^/(?=[\x00-\x7F]:)", ""))


def encode_location(path: Column) -> Column:
    """The file URL of a path; letters, digits and - . _ ~ / : stay."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    coded = F.url_encode(posix)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return F.concat(F.when(posix.startswith("/"), F.lit("file://localhost")).otherwise(F.lit("file://localhost/")), coded)


def sanitized(name: Column) -> Column:
    """A name that FAT32 takes: forbidden characters become _, dots and blanks at the end go; "track" if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[<>:\"/\\|?*\x00-\x1F]", "_"), r"[. ]+\z", "")
    return F.regexp_replace(bare, r"\A\z", "track")


def folder_parts(path: Column) -> Column:
    """The folders above a path, from the top; the first is empty for an absolute path, and a bare name has none."""
    return F.when(F.contains(path, F.lit("/")), F.split(dirname(path), "/")).otherwise(F.array().cast("array<string>"))


def relative_to(path: Column, base: Column) -> Column:
    """The path below base; just the name if it isn't below it. An empty base holds relative paths only, / holds absolute ones."""
    head = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    below = F.when(base == "", ~path.startswith("/")).otherwise(path.startswith(head) & (path != head))
    rest = F.when(base == "", path).otherwise(F.substring(path, F.length(head) + 1, F.length(path)))
    return F.when(F.coalesce(below, F.lit(False)), rest).otherwise(basename(path))

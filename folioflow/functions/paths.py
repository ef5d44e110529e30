"""Archive paths, media types, binary signatures and geometry as columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy

#: Fixed values.
MEDIA = {"md": "text/markdown", "json": "application/json", "epub": "application/epub+zip", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
INPUT_MEDIA = {"xhtml": "application/xhtml+xml", "xht": "application/xhtml+xml", "html": "text/html", "htm": "text/html", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "css": "text/css", "ncx": "application/x-dtbncx+xml"}
SIGNATURES = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": ("474946383761", "474946383961"), "image/webp": ("52494646", "57454250")}


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def by_extension(path: Column, table: dict[str, str], default: str | None) -> Column:
    ext, out = extension(path), None
    for e, media in table.items():
        out = F.when(ext == e, media) if out is None else out.when(ext == e, media)
    return out.otherwise(F.lit(default))


def valid_entry(path: Column) -> Column:
    """A relative path without traversal, within the length limits."""
    bare = F.regexp_replace(path, "/$", "")
    parts = F.split(bare, "/")
    bad = F.exists(parts, lambda s: s.isin("", ".", "..") | (F.length(s) > policy.MAX_SEGMENT))
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.contains("\0") & ~path.startswith("/") & ~path.rlike("^[A-Za-z]:") & ~bad & (F.length(bare) <= policy.MAX_PATH), F.lit(False))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def starts_with_bytes(data: Column, hexed: str, at: int = 1) -> Column:
    return F.hex(F.substring(data, at, len(hexed) // 2)) == hexed


def raster_type(data: Column) -> Column:
    png, jpeg, gifs, (riff, webp) = SIGNATURES.values()
    return (
        F.when(starts_with_bytes(data, png), "image/png")
        .when(starts_with_bytes(data, jpeg) & (F.octet_length(data) >= 4), "image/jpeg")
        .when(starts_with_bytes(data, gifs[0]) | starts_with_bytes(data, gifs[1]), "image/gif")
        .when(starts_with_bytes(data, riff) & starts_with_bytes(data, webp, 9), "image/webp")
    )


def zip_signature(data: Column) -> Column:
    third, fourth = F.hex(F.substring(data, 3, 1)), F.hex(F.substring(data, 4, 1))
    return starts_with_bytes(data, "504B") & third.isin("03", "05", "07") & fourth.isin("04", "06", "08")


def detected(data: Column, name: Column) -> Column:
    """Format by magic bytes, then suffix, then the first 2,048 bytes; archives are told apart by ``sources``."""
    low, head = F.lower(name), F.decode(F.substring(data, 1, 2048), "ISO-8859-1")
    return F.when(starts_with_bytes(data, "255044462D"), "pdf").when(starts_with_bytes(data, "504B"), F.when(low.endswith(".fb2.zip"), "fb2zip").otherwise("epub")).when(low.endswith(".fb2") | head.contains("<FictionBook"), "fb2")


#: Which output files a selection keeps. ``*`` always holds, ``archive`` is a profile, the others are output groups.
KEPT = (
    ("*", r"(?:SECURITY-REPORT\.md|REPAIR-REPORT\.md|notebooklm/LLM-SAFETY-REPORT\.md|repair/.*)"),
    ("archive", r"notebooklm/(?:book|document)\.md"),
    ("visual-source", r"notebooklm/(?:book\.sanitized\.epub|document\.sanitized\.pdf|README\.md)"),
    ("markdown", r"(?:book|document)\.md"),
    ("chunks", r"(?:(?:chapters|pages|sections)/.*|OUTLINE\.md)"),
    ("assets", r"(?:assets/.*|notebooklm/(?:FIGURE-INDEX\.md|document\.sanitized\.pdf))"),
)


def kept(path: Column, outputs: Column, profile: Column) -> Column:
    """Whether an output file belongs to a selection; reports always do."""
    holds = {"*": F.lit(True), "archive": profile == "archive"}
    out = F.lit(False)
    for group, pattern in KEPT:
        out = out | (holds.get(group, F.array_contains(outputs, group)) & path.rlike(f"^{pattern}$"))
    return out


def is_kept(path: str, outputs, profile: str) -> bool:
    """``kept`` as a Python function."""
    return any((group == "*" or group == profile == "archive" or group in outputs) and re.fullmatch(pattern, path) for group, pattern in KEPT)


def is_titled(path: str, stem: str) -> str:
    """``titled`` as a Python function."""
    return TITLED[path].format(stem) if path in TITLED else path


def media_of(path: str) -> str:
    return MEDIA.get(path.rsplit(".", 1)[-1].lower(), "application/octet-stream")


#: The order of characters before digits and letters in the root collation.
_ORDER = {c: k for k, c in enumerate("_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$")}


@lru_cache(maxsize=4096)
def _rank(c: str) -> tuple:
    return (0, _ORDER.get(c, -1), "") if not c.isalnum() else (1, 0, c) if c.isdigit() else (2, 0, c.casefold())


@lru_cache(maxsize=1024)
def collation_key(path: str) -> tuple:
    """Order of paths as people read them: punctuation, digits, letters whatever their case; then accents, then small letters first."""
    flat = unicodedata.normalize("NFD", path)
    marks = [] if path.isascii() else [c for c in flat if unicodedata.combining(c)]
    base = [c for c in flat if not unicodedata.combining(c)] if marks else flat
    return list(map(_rank, base)), marks, list(map(str.isupper, base)), path


#: Internal path and what the title's stem makes of it.
TITLED = {
    "book.md": "{}.md", "document.md": "{}.md", "notebooklm/book.sanitized.epub": "notebooklm/{}.sanitized.epub", "notebooklm/document.sanitized.pdf": "notebooklm/{}.sanitized.pdf", "notebooklm/book.md": "notebooklm/{}.md",
    "notebooklm/document.md": "notebooklm/{}.md", "notebooklm/FIGURE-INDEX.md": "notebooklm/{}.figure-index.md", "notebooklm/LLM-SAFETY-REPORT.md": "notebooklm/{}.llm-safety-report.md", "SECURITY-REPORT.md": "{}.security-report.md",
    "REPAIR-REPORT.md": "{}.repair-report.md", "repair/source.repaired.epub": "repair/{}.repaired.epub", "repair/source.repaired.fb2.zip": "repair/{}.repaired.fb2.zip", "OUTLINE.md": "{}.outline.md",
}


def titled(path: Column, stem: Column) -> Column:
    out = F.when(F.lit(False), path)
    for internal, shape in TITLED.items():
        before, after = shape.split("{}")
        out = out.when(path == internal, F.concat(F.lit(before), stem, F.lit(after)))
    return out.otherwise(path)


def render_scale(area: Column) -> Column:
    """Scale within the pixel budget; null below 0.85."""
    scale = F.least(F.lit(2.2), F.sqrt(F.lit(float(policy.MAX_VISUAL_PIXELS)) / F.greatest(area, F.lit(1.0))))
    return F.when(scale >= 0.85, scale)


def jpeg_quality(pages: Column) -> Column:
    return F.when(pages <= 40, 0.96).when(pages <= 180, 0.94).otherwise(0.91)

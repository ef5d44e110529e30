"""SVG images rebuilt from an allowlist of elements, attributes and style properties; what is not listed goes, with a warning where it was active."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.batches import pieces
from ..policy import DocumentError

#: Fixed values, each in its canonical spelling; input is compared in lower case.
ELEMENTS = "svg g defs desc title symbol use switch path rect circle ellipse line polyline polygon text tspan textPath image linearGradient radialGradient stop pattern clipPath mask marker view a".split()
PAINT = "fill fill-opacity fill-rule stroke stroke-width stroke-opacity stroke-linecap stroke-linejoin stroke-miterlimit stroke-dasharray stroke-dashoffset opacity color clip-rule display visibility vector-effect shape-rendering text-rendering font-family font-size font-style font-weight text-anchor dominant-baseline stop-color stop-opacity".split()
ATTRIBUTES = [
    *"id class role version x y x1 y1 x2 y2 dx dy cx cy r rx ry width height d points pathLength transform viewBox preserveAspectRatio rotate textLength lengthAdjust".split(),
    *"gradientUnits gradientTransform spreadMethod offset patternUnits patternContentUnits patternTransform maskunits markerunits markerwidth markerheight refX refY orient".split(),
    *PAINT,
]
UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f<>\\]|(?:javascript|vbscript|data|file|https?|ftp)\s*:|@import|expression\s*\(", re.I)
FRAGMENT = re.compile(r"#[^\s\"'<>\\]{1,256}")
_ELEMENT, _ATTRIBUTE = {x.lower(): x for x in ELEMENTS}, {x.lower(): x for x in ATTRIBUTES}


def passive(value: str) -> bool:
    """A value without addresses, scripts, imports or references to other files."""
    urls = re.findall(r"url\(([^)]*)\)", value, re.I)
    return len(value) <= 1_000_000 and not UNSAFE.search(value) and all(FRAGMENT.fullmatch(u.strip().strip("\"'")) for u in urls)


def passive_style(value: str) -> str:
    """The declarations that are listed and passive."""
    pairs = [(p.strip().lower(), v.strip()) for p, colon, v in (d.partition(":") for d in value.split(";")) if colon]
    return "; ".join(f"{p}: {v}" for p, v in pairs if p in PAINT and v and passive(v))


class _Rebuilt:
    def __init__(self, image: Callable[[str], str | None]):
        self.image, self.out, self.warnings = image, [], []
        self.depth = self.nodes = 0
        self.closing: list[str | None] = []
        self.dropped = 0
        self.root = False

    def warn(self, message: str) -> None:
        if message not in self.warnings and len(self.warnings) < policy.MAX_WARNINGS:
            self.warnings.append(message)

    def count(self) -> None:
        self.nodes += 1
        if self.nodes > policy.SVG_NODES:
            raise DocumentError("LIMIT_EXCEEDED", "an SVG image has too many nodes")

    def start(self, tag: str, attrs: dict) -> None:
        self.count()
        self.depth += 1
        if self.depth > policy.SVG_DEPTH:
            raise DocumentError("LIMIT_EXCEEDED", "an SVG image is nested too deeply")
        name = _ELEMENT.get(tag.lower())
        kept = None if self.dropped or (not self.root and name != "svg") else self.attributes(name, attrs) if name else None
        if kept is None:
            if not self.dropped and not name:
                self.warn(f"Removed the SVG element <{tag[:40]}>.")
            self.dropped += 1
            self.closing.append(None)
            return
        if name == "svg":
            kept["xmlns"] = "http://www.w3.org/2000/svg"
        self.root = True
        self.out.append(f"<{name}" + "".join(f' {k}="{escape(v)}"' for k, v in kept.items()) + ">")
        self.closing.append(name)

    def end(self, _: str) -> None:
        self.depth -= 1
        name = self.closing.pop()
        if name is None:
            self.dropped -= 1
        else:
            self.out.append(f"</{name}>")

    def data(self, said: str) -> None:
        self.count()
        if not self.dropped and self.root and self.closing:
            self.out.append(escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", said), quote=False))

    def attributes(self, name: str, attrs: dict) -> dict | None:
        """The attributes to keep; None if the element makes no sense without what was refused."""
        out: dict[str, str] = {}
        shown = name != "image"
        for key, value in attrs.items():
            low = key.lower()
            if low.startswith("on"):
                self.warn("Removed event handlers of an SVG image.")
            elif low.startswith("aria-"):
                if passive(value):
                    out[key] = value[:500]
            elif low == "style":
                if kept := passive_style(value):
                    out["style"] = kept
                elif value.strip():
                    self.warn("Removed styles of an SVG image.")
            elif low in ("href", "xlink:href"):
                to = value.strip()
                if name == "image":
                    if path := self.image(to):
                        out["href"], shown = path, True
                    else:
                        self.warn("Removed an image within an SVG image: its source is not a safe one of the document.")
                elif FRAGMENT.fullmatch(to):
                    out["href"] = to
                elif to:
                    self.warn("Removed a reference of an SVG image to another place.")
            elif low in _ATTRIBUTE:
                if passive(value):
                    out[_ATTRIBUTE[low]] = value
                else:
                    self.warn("Removed unsafe values of an SVG image.")
        return out if shown else None


def sanitized(data: bytes, image: Callable[[str], str | None] = lambda reference: None) -> tuple[bytes, list[str]]:
    """The passive image and the warnings; ``image`` gives the output name of an image within it."""
    if len(data) > policy.MAX_SVG:
        raise DocumentError("LIMIT_EXCEEDED", "an SVG image is too large")
    try:
        markup = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise DocumentError("INVALID_DOCUMENT", "an SVG image is not UTF-8") from e
    if re.search("<!(doctype|entity)", markup, re.I):
        raise DocumentError("UNSAFE_XML", "document types and entities are not allowed")
    build, parser = _Rebuilt(image), expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = build.start, build.end, build.data
    try:
        parser.Parse(re.sub(r"^\s*<\?xml[^>]*\?>", "", markup).encode(), True)
    except expat.ExpatError as e:
        raise DocumentError("INVALID_DOCUMENT", "an SVG image is not well formed") from e
    if not build.root:
        raise DocumentError("INVALID_DOCUMENT", "an SVG image has no root")
    content = "".join(build.out).encode()
    if len(content) > policy.MAX_SVG:
        raise DocumentError("LIMIT_EXCEEDED", "an SVG image is too large")
    return content, build.warnings


def images(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, ``svg``, ``warnings``, ``error`` (code, or null) of rows with SVG bytes, in Arrow batches."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    content, warnings = sanitized(data or b"")
                    out.append((content.decode(), warnings, None))
                except DocumentError as e:
                    out.append((None, [], e.code))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "svg", "warnings", "error"])

    return rows.select(F.col(id_col), F.col(data_col).cast("binary")).mapInArrow(run, f"id {kind}, svg string, warnings array<string>, error string").withColumnRenamed("id", id_col)

"""EPUB, FictionBook 2 and PDF files to chapters, figures and unit rows; preflight of the same."""

from __future__ import annotations

import base64
import binascii
import contextlib
import math
import posixpath
import re
import signal
import threading
from urllib.parse import unquote_to_bytes
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .. import policy
from ..functions import paths, text
from ..functions.batches import gathered, pieces
from ..operators import svg
from ..operators.book import chapter_id, merged_repairs
from ..operators.html import to_markdown
from ..policy import DocumentError
from . import archives, pdf

_ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "ascii", "iso-8859-1": "cp1252", "windows-1251": "cp1251", "windows-1252": "cp1252", "koi8-r": "koi8-r", "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}


def decode_xml(data: bytes) -> str:
    """By byte-order mark, then by the pattern of zero bytes, then by the declared encoding if it is an allowed one."""
    marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
    skip, name = next(((len(m), n) for m, n in marks if data.startswith(m)), (0, None))
    if name is None and data[:2] in (b"<\0", b"\0<"):
        name = "utf-16-le" if data[0] else "utf-16-be"
    if name is None:
        declared = re.match(rb"\s*<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data)
        name = declared[1].decode().lower() if declared else "utf-8"
        if name not in _ENCODINGS:
            raise DocumentError("UNSUPPORTED_DOCUMENT", f"encoding {name}")
        name = _ENCODINGS[name]
    try:
        return data[skip:].decode(name)
    except UnicodeDecodeError as e:
        raise DocumentError("INVALID_DOCUMENT", "text does not fit its encoding") from e


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def all(self, tag: str):
        for c in self.children:
            if isinstance(c, Node):
                if c.tag == tag:
                    yield c
                yield from c.all(tag)

    def own(self, *tags: str):
        return [c for c in self.children if isinstance(c, Node) and (not tags or c.tag in tags)]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def href(self) -> str:
        return next((v for k, v in self.attrs.items() if k.split(":")[-1] == "href"), "")


def parse_xml(source: str | bytes, limit: int) -> Node:
    """A tree without prefixes; document types and entities are refused before parsing."""
    if len(source) > limit:
        raise DocumentError("LIMIT_EXCEEDED", "XML too large")
    body = decode_xml(source) if isinstance(source, bytes) else source
    if re.search("<!(doctype|entity)", body, re.I):
        raise DocumentError("UNSAFE_XML", "document types and entities are not allowed")
    body = re.sub(r"^\s*<\?xml[^>]*\?>", "", body)
    root, stack = Node("", {}), []
    stack.append(root)
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def start(tag, attrs):
        node = Node(tag.split(":")[-1], attrs)
        stack[-1].children.append(node)
        stack.append(node)
        if len(stack) > policy.XML_DEPTH:
            raise DocumentError("LIMIT_EXCEEDED", "XML is nested too deeply")

    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].children.append(data)
    try:
        parser.Parse(body.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise DocumentError("INVALID_DOCUMENT", "XML is not well formed") from e
    return root


def resolve(base: str, reference: str) -> str | None:
    """A reference within the archive, without query and fragment; None if it leaves it."""
    bare = re.split("[?#]", reference, maxsplit=1)[0]
    try:
        bare = unquote_to_bytes(bare).decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not bare or bare.startswith("/") or "\\" in bare or "\0" in bare or re.match("[A-Za-z][A-Za-z0-9+.-]*:", bare):
        return None
    joined = posixpath.normpath(posixpath.join(posixpath.dirname(base), bare))
    return None if joined.startswith("..") else joined


def without_doctype(markup: str) -> str:
    """Drops inert document types; entities, an internal subset or a type without an end are refused."""
    if re.search("<!entity", markup, re.I):
        raise DocumentError("UNSAFE_XML", "entities are not allowed")
    out, at = [], 0
    for m in re.finditer("<!doctype", markup, re.I):
        if m.start() < at:
            continue
        # quoted parts may hold the characters that end or open a type
        body = re.compile(r"""(?:[^<>\[\]"']|"[^"]*"|'[^']*')*>""").match(markup, m.end())
        if not body:
            raise DocumentError("UNSAFE_XML", "a document type has an internal subset or no end")
        out.append(markup[at : m.start()])
        at = body.end()
    return "".join([*out, markup[at:]])


def signed(kind: str, data: bytes) -> bool:
    """Whether the bytes begin as the raster type must."""
    signs = paths.SIGNATURES.get(kind, ())
    if kind == "image/webp":
        return data[:4] == bytes.fromhex(signs[0]) and data[8:12] == bytes.fromhex(signs[1])
    return len(data) >= 4 and any(data.startswith(bytes.fromhex(x)) for x in ((signs,) if isinstance(signs, str) else signs))


_EXTENSION = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg"}


def figure(n: int, name: str, kind: str, data: bytes) -> dict:
    """A figure: ``id``, output ``path``, ``media``, ``label``, ``data``."""
    key = f"FIG-{n:04d}"
    safe = re.sub("[()]", "-", text.safe_name(name, f"image-{n}"))
    return {"id": key, "path": f"assets/{key}-{safe}.{_EXTENSION[kind]}", "media": kind, "label": name, "data": data}


def title_of(markdown: str, fallback: str) -> str:
    m = re.search(r"(?m)^#{1,6}\s+(.+)$", markdown)
    return text.safe_name(re.sub(r"[*_`\[\]]", "", m[1]).strip() if m else fallback, fallback)


def read_package(entries: dict[str, bytes], package: str) -> dict:
    """Title, author, language, manifest and spine; the first of two items with one id counts, gaps of the spine stay."""
    root = parse_xml(entries[package], policy.MAX_XML)
    one = lambda tag: next((n.text().strip() for n in root.all(tag) if n.text().strip()), None)
    manifest: dict[str, dict] = {}
    warnings, repairs = [], []
    for item in root.all("item"):
        path, key = resolve(package, item.attrs.get("href", "")), item.attrs.get("id")
        media = item.attrs.get("media-type")
        if not media and path and (media := paths.INPUT_MEDIA.get(path.rsplit(".", 1)[-1].lower())):
            repairs.append(f"A missing media type was inferred for {path}.")
        if not key or not path or not media or key in manifest:
            warnings.append("A manifest item was left out.")
            continue
        manifest[key] = {"id": key, "path": path, "media": media, "properties": item.attrs.get("properties", "").split()}
    spine = []
    for i, ref in enumerate(root.all("itemref")):
        item = manifest.get(ref.attrs.get("idref", ""))
        if item is None:
            warnings.append("A spine entry has no manifest item.")
            repairs.append("A dangling spine entry was left out.")
        elif item["media"] in ("application/xhtml+xml", "text/html") or item["media"].startswith("image/"):
            spine.append((i, item))
    if not spine:
        spine = [(i, m) for i, m in enumerate(manifest.values()) if m["media"] in ("application/xhtml+xml", "text/html") and "nav" not in m["properties"]]
    if not spine:
        raise DocumentError("INVALID_DOCUMENT", "nothing to read")
    return {"title": text.METADATA(one("title")) or None, "author": one("creator"), "language": one("language"), "manifest": manifest, "spine": spine, "warnings": warnings, "repairs": repairs}


def open_epub(content: bytes) -> dict:
    """``entries``, ``book``, ``repair`` (or None) and ``copy``, the repaired file where nothing had to be guessed."""
    entries, repair = archives.open_recoverable(content)
    before, actions = dict(entries), []
    if entries.get("mimetype", b"").strip() != b"application/epub+zip":
        entries["mimetype"] = b"application/epub+zip"
        actions.append("The mimetype was restored.")
    package = None
    if container := entries.get("META-INF/container.xml"):
        found = [n for n in parse_xml(container, policy.MAX_XML).all("rootfile") if n.attrs.get("full-path", "") in entries]
        found.sort(key=lambda n: n.attrs.get("media-type") != "application/oebps-package+xml")
        package = found[0].attrs["full-path"] if found else None
    failure = None
    if package is not None:
        try:
            book = read_package(entries, package)
        except DocumentError as e:
            failure, package = e, None
    if package is None:
        able = []
        candidates = [p for p in entries if p.lower().endswith(".opf")]
        if len(candidates) > policy.MAX_PACKAGES:
            raise DocumentError("LIMIT_EXCEEDED", "too many package documents")
        for p in candidates:
            try:
                able.append((p, read_package(entries, p)))
            except DocumentError:
                continue
        if len(able) > 1:
            raise DocumentError("AMBIGUOUS_REPAIR", "several package documents can be read")
        if not able:
            raise failure or DocumentError("INVALID_DOCUMENT", "no package document")
        package, book = able[0]
        entries["META-INF/container.xml"] = f'<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{text.XML_TEXT(package)}" media-type="application/oebps-package+xml"/></rootfiles></container>'.encode()
        actions.append("The container was rebuilt.")
    copy = archives.canonical(entries) if repair or actions else None
    if actions:
        own = {"level": "automatic", "actions": actions, "original_bytes": repair["repaired_bytes"] if repair else len(content), "repaired_bytes": len(copy), "omitted": 0}
        repair = merged_repairs(repair, own)
    if book["repairs"]:
        last = repair["repaired_bytes"] if repair else len(content)
        repair = merged_repairs(repair, {"level": "automatic", "actions": book["repairs"][: policy.MAX_REPAIRS], "original_bytes": last, "repaired_bytes": last, "omitted": 0})
        copy = None
    return {"entries": entries, "book": book, "repair": repair, "copy": copy, "bytes": sum(map(len, before.values()))}


def read_epub(content: bytes) -> dict:
    source = open_epub(content)
    entries, book = source["entries"], source["book"]
    figures: list[dict] = []
    by_path: dict[str, dict] = {}
    warnings = list(book["warnings"])
    if source["repair"]:
        warnings.append("The source was repaired" + (" in part: check whether it is complete." if source["repair"]["level"] == "salvage" else "."))
    stem = lambda item: posixpath.splitext(posixpath.basename(item["path"]))[0]
    for key, item in book["manifest"].items():
        if item["media"] in paths.SIGNATURES:
            data = entries.get(item["path"])
            if data is not None and signed(item["media"], data):
                figures.append(figure(len(figures) + 1, stem(item), item["media"], data))
                by_path[item["path"]] = figures[-1]
            else:
                warnings.append(f"The image {key} is missing or does not have its type's signature.")
    rasters = dict(by_path)

    def in_svg(base: str):
        return lambda reference: f["path"].rsplit("/", 1)[-1] if (f := rasters.get(resolve(base, reference))) else None

    for key, item in book["manifest"].items():
        if item["media"] == "image/svg+xml":
            try:
                if item["path"] not in entries:
                    raise DocumentError("INVALID_DOCUMENT", "it is missing")
                clean, said = svg.sanitized(entries[item["path"]], in_svg(item["path"]))
            except DocumentError as e:
                warnings.append(f"The SVG image {key} was left out: {e}")
                continue
            warnings += said
            figures.append(figure(len(figures) + 1, stem(item), "image/svg+xml", clean))
            by_path[item["path"]] = figures[-1]
    sequence = {item["path"]: i + 1 for i, item in book["spine"]}
    units = []
    for i, item in book["spine"]:
        data, base = entries.get(item["path"]), item["path"]
        if item["media"].startswith("image/"):
            if base not in by_path:
                warnings.append("A picture of the reading order could not be read.")
                continue
            title = text.safe_name(item["id"], f"Page {i + 1}")
            markdown = f"# {text.INLINE(title)}\n\n![{text.INLINE(title)}]({by_path[base]['path']})"
        else:
            if data is None:
                warnings.append("A document of the reading order is missing.")
                continue
            if len(data) > policy.MAX_XHTML:
                raise DocumentError("LIMIT_EXCEEDED", "chapter too large")

            def inline_svg(markup: str, label: str, base=base):
                try:
                    clean, said = svg.sanitized(markup.encode(), in_svg(base))
                except DocumentError:
                    return None
                warnings.extend(said)
                figures.append(figure(len(figures) + 1, f"inline-{label}", "image/svg+xml", clean) | {"label": label})
                by_path[figures[-1]["path"]] = figures[-1]
                return figures[-1]["path"]

            markdown, said, _ = to_markdown(
                without_doctype(decode_xml(data)),
                lambda src, base=base: f["path"] if (f := by_path.get(resolve(base, src))) else None,
                lambda href, base=base: chapter_id(n) if (n := sequence.get(resolve(base, href))) else None,
                inline_svg,
            )
            warnings += said
            title = title_of(markdown, text.safe_name(item["id"], f"Chapter {i + 1}"))
            markdown = markdown or f"# {title}\n\n[Empty chapter]"
        units.append({"seq": i + 1, "title": title, "raw": markdown, "canonical": "nav" not in item["properties"]})
    if not units:
        raise DocumentError("UNSUPPORTED_DOCUMENT", "nothing safe to read")
    return {"format": "epub", "title": book["title"], "author": book["author"], "language": book["language"], "units": units, "assets": figures, "warnings": distinct(warnings), "repair": source["repair"], "copy": source["copy"], "bytes": source["bytes"]}


def distinct(warnings: list[str]) -> list[str]:
    """The first of equal warnings, so many at most."""
    return list(dict.fromkeys(warnings))[: policy.MAX_WARNINGS]


def inspect_epub(content: bytes) -> dict:
    source = open_epub(content)
    book = source["book"]
    graphics = sum(m["media"] in paths.SIGNATURES or m["media"] == "image/svg+xml" for m in book["manifest"].values())
    return {"format": "epub", "title": book["title"], "author": book["author"], "language": book["language"], "units": len(book["spine"]), "unit_label": "chapters", "graphics": graphics, "processed_bytes": source["bytes"], "warnings": distinct(book["warnings"]), "repair": source["repair"]}


_REFERENCE = re.compile(r"[A-Za-z0-9_.:-]{1,240}")


def reference_of(href: str) -> str | None:
    """The id that a reference within a FictionBook names."""
    bare = href.strip().removeprefix("#")
    return bare if _REFERENCE.fullmatch(bare) else None


class _Fb2:
    """Writes the blocks of a FictionBook as Markdown."""

    MARKS = {"strong": "**", "b": "**", "emphasis": "*", "i": "*", "strikethrough": "~~"}

    def __init__(self, images: dict[str, dict], warnings: list[str]):
        self.images, self.warnings = images, warnings

    def inline(self, node: Node) -> str:
        out = []
        for c in node.children:
            if isinstance(c, str):
                out.append(text.FB2_INLINE(c))
            elif c.tag == "image":
                out.append(self.image(c))
            elif inner := text.NORMAL(self.inline(c)):
                if c.tag == "code":
                    inner = "`" + inner.replace("`", "\\`") + "`"
                elif c.tag == "a":
                    key = reference_of(c.href())
                    if key:
                        inner += f" (see note #{text.FB2_INLINE(key, 240)})"
                    elif c.href():
                        self.warnings.append("A link to another place was removed.")
                mark = self.MARKS.get(c.tag, "")
                out.append(mark + inner + mark)
        return "".join(out)

    def image(self, node: Node) -> str:
        found = self.images.get((reference_of(node.href()) or "").lower())
        if not found:
            self.warnings.append("An image has no safe picture in the file.")
            return "[Image omitted]"
        return f"![{text.NORMAL(text.FB2_INLINE(node.attrs.get('title') or found['label'], 500))}]({found['path']})"

    def line(self, node: Node) -> str:
        return text.NORMAL(self.inline(node))

    def blocks(self, node: Node, level: int) -> list[str]:
        out: list[str] = []
        for c in node.own():
            if c.tag == "section":
                out += self.blocks(c, min(6, level + 1))
            elif c.tag in ("title", "subtitle"):
                words = " ".join(filter(None, map(self.line, c.own("p") or [c])))
                out.append("#" * min(6, level + (c.tag == "subtitle")) + " " + words if words else "")
            elif c.tag in ("p", "text-author", "date"):
                out.append(self.line(c))
            elif c.tag == "image":
                out.append(self.image(c))
            elif c.tag == "table":
                rows = [r for r in ([self.line(x).replace("|", "\\|") for x in [*r.own("th"), *r.own("td")]] for r in c.own("tr")) if r]
                width = max(map(len, rows), default=0)
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join(lines[:1] + ["|" + " --- |" * width] + lines[1:]) if lines else "")
            elif c.tag == "v":
                out.append(text.quoted_lines(self.line(c)))
            elif c.tag in ("epigraph", "cite", "poem"):
                out.append(text.quoted_lines("\n\n".join(self.blocks(c, level))))
            elif c.tag != "empty-line":
                out += self.blocks(c, level)
        return [x for x in out if x]


def _fb2_root(content: bytes) -> tuple[Node, dict | None, bytes | None, int]:
    repair = copy = None
    size = len(content)
    if content[:2] == b"PK":
        entries, repair = archives.open_recoverable(content)
        size = sum(map(len, entries.values()))
        books = [d for p, d in entries.items() if p.lower().endswith(".fb2")]
        if len(books) != 1:
            raise DocumentError("INVALID_DOCUMENT", "exactly one .fb2 entry is needed")
        content, copy = books[0], archives.canonical(entries) if repair else None
    book = next(iter(parse_xml(content, policy.MAX_FB2).own("FictionBook")), None)
    if book is None:
        raise DocumentError("INVALID_DOCUMENT", "not a FictionBook")
    return book, repair, copy, size


def _fb2_facts(book: Node) -> dict:
    info = next(iter(book.all("title-info")), Node("", {}))
    one = lambda tag: next((t for n in info.all(tag) if (t := text.METADATA(n.text()))), None)
    writer = next(iter(info.all("author")), Node("", {}))
    names = [t for tag in ("first-name", "middle-name", "last-name") for n in writer.own(tag)[:1] if (t := text.METADATA(n.text()))]
    nick = next((t for n in writer.own("nickname") if (t := text.METADATA(n.text()))), None)
    cover = next((reference_of(i.href()) for c in info.all("coverpage") for i in c.all("image")), None)
    return {"format": "fb2", "title": one("book-title") or "Untitled", "author": " ".join(names) or nick, "language": one("lang"), "cover": cover}


def read_fb2(content: bytes) -> dict:
    book, repair, copy, size = _fb2_root(content)
    facts = _fb2_facts(book)
    images: dict[str, dict | None] = {}
    figures: list[dict] = []
    warnings: list[str] = []
    drawings: list[tuple[str, bytes]] = []
    total = 0
    for b in book.own("binary"):
        name = reference_of(b.attrs.get("id", ""))
        if name is None or name.lower() in images:
            raise DocumentError("INVALID_DOCUMENT", "bad or repeated id of a binary")
        compact = re.sub(r"\s+", "", b.text())
        try:
            data = base64.b64decode(compact, validate=True)
        except (binascii.Error, ValueError) as e:
            raise DocumentError("INVALID_DOCUMENT", "bad Base64") from e
        total += len(data)
        if not data or len(data) > policy.MAX_FB2_BINARY or total > policy.MAX_FB2_BINARIES:
            raise DocumentError("LIMIT_EXCEEDED" if data else "INVALID_DOCUMENT", "a binary is empty or too large")
        kind = b.attrs.get("content-type", "").strip().lower()
        kind = "image/jpeg" if kind == "image/jpg" else kind
        images[name.lower()] = None
        if kind == "image/svg+xml":
            drawings.append((name, data))
        elif signed(kind, data):
            figures.append(figure(len(figures) + 1, posixpath.splitext(name)[0], kind, data))
            images[name.lower()] = figures[-1]
        else:
            warnings.append("An image was left out: its type or signature does not fit.")
    for name, data in drawings:
        try:
            inner = lambda r: f["path"].rsplit("/", 1)[-1] if (f := images.get((reference_of(r) or "").lower())) and f["media"] != "image/svg+xml" else None
            clean, said = svg.sanitized(data, inner)
        except DocumentError as e:
            warnings.append(f"An SVG image was left out: {e}")
            continue
        warnings += said
        figures.append(figure(len(figures) + 1, posixpath.splitext(name)[0], "image/svg+xml", clean))
        images[name.lower()] = figures[-1]
    writer, units = _Fb2({k: v for k, v in images.items() if v}, warnings), []

    def add(blocks: list[str], fallback: str):
        if blocks:
            markdown = "\n\n".join(blocks)
            units.append({"seq": len(units) + 1, "title": title_of(markdown, text.safe_name(fallback, f"Chapter {len(units) + 1}")), "raw": markdown, "canonical": True})

    if facts["cover"] and (f := images.get(facts["cover"].lower())):
        add(["# Cover", f"![{text.NORMAL(text.FB2_INLINE(f['label'], 500))}]({f['path']})"], "Cover")
    for part, body in enumerate(book.own("body"), 1):
        loose = Node("body", {})
        loose.children = [c for c in body.own() if c.tag != "section"]
        add(writer.blocks(loose, 1), body.attrs.get("name") or ("Front matter" if part == 1 else f"Part {part}"))
        for k, section in enumerate(body.own("section"), 1):
            add(writer.blocks(section, 1), f"Section {k}")
    if not units:
        raise DocumentError("UNSUPPORTED_DOCUMENT", "nothing to read")
    return facts | {"units": units, "assets": figures, "warnings": distinct(warnings), "repair": repair, "copy": copy, "bytes": size}


def inspect_fb2(content: bytes) -> dict:
    book, repair, _, size = _fb2_root(content)
    units = max(1, sum(max(1, len(b.own("section"))) for b in book.own("body")))
    return _fb2_facts(book) | {"units": units, "unit_label": "chapters", "graphics": sum(1 for _ in book.all("binary")), "processed_bytes": size, "warnings": [], "repair": repair}


def read_pdf(content: bytes) -> dict:
    d = pdf.read(content)
    warnings = [f"Page {p['number']} has no text." for p in d["pages"] if not p["plain"]]
    if d["glyphs"]:
        warnings.append(f"{d['glyphs']:,} characters on {d['repaired_pages']:,} pages were read by the names of their glyphs.")
    units = [{"seq": p["number"], "title": p["id"], "raw": p["markdown"], "canonical": True} for p in d["pages"]]
    return d | {"format": "pdf", "title": d["title"], "language": None, "units": units, "assets": [], "warnings": distinct(warnings), "repair": None, "copy": None}


def inspect_pdf(content: bytes) -> dict:
    """Preflight of a PDF: pages without text, and what reading them by OCR would need."""
    d = pdf.read(content)
    blank = [p for p in d["pages"] if not any(i["str"].strip() for i in p["items"])]
    pixels = 0
    for p in blank:
        area = max(1.0, p["width"] * p["height"])
        scale = min(2.2, math.sqrt(policy.MAX_OCR_PAGE_PIXELS / area))
        pixels += max(1, math.ceil(p["width"] * scale)) * max(1, math.ceil(p["height"] * scale))
    n = len(d["pages"])
    coverage = "full" if not blank else "none" if len(blank) == n else "partial"
    warnings = ([f"{len(blank)} of {n} pages have no text."] if blank else []) + ([f"{d['repaired_pages']} of {n} pages have incomplete font maps."] if d["repaired_pages"] else [])
    return {"format": "pdf", "title": d["title"], "author": d["author"], "language": None, "units": n, "unit_label": "pages", "graphics": n, "processed_bytes": len(content), "warnings": warnings, "repair": None, "coverage": coverage, "checked_pages": n, "image_only_pages": len(blank), "ocr_pixels": pixels, "ocr_within_budget": len(blank) <= policy.MAX_OCR_PAGES and pixels <= policy.MAX_OCR_PIXELS}


def detect(content: bytes, name: str) -> str:
    """Format by magic bytes, archive content, suffix and a sniff of the head, in this order."""
    low = name.lower()
    if content.startswith(b"%PDF-"):
        return "pdf"
    if len(content) >= 4 and content[:2] == b"PK":
        names = archives.open_recoverable(content)[0]
        if "META-INF/container.xml" in names:
            return "epub"
        return "fb2" if any(n.lower().endswith(".fb2") for n in names) or low.endswith(".fb2.zip") else "epub"
    if low.endswith(".fb2") or re.search(rb"<(?:[A-Za-z_][\w.-]*:)?FictionBook\b", content[:2048].replace(b"\0", b""), re.I):
        return "fb2"
    raise DocumentError("INVALID_DOCUMENT", "unknown format")


_READ = {"epub": read_epub, "fb2": read_fb2, "pdf": read_pdf}
_INSPECT = {"epub": inspect_epub, "fb2": inspect_fb2, "pdf": inspect_pdf}


def _stem(name: str) -> str:
    return text.safe_name(re.sub(r"(?i)\.(epub|fb2\.zip|fb2|pdf)$", "", posixpath.basename(name)), "document")


def read_document(content: bytes, name: str) -> dict:
    if len(content) > policy.MAX_INPUT:
        raise DocumentError("LIMIT_EXCEEDED", "the file is too large")
    d = _READ[detect(content, name)](content)
    return d | {"title": d["title"] or _stem(name)}


def inspect_document(content: bytes, name: str) -> dict:
    """What a file holds, before it is converted."""
    if len(content) > policy.MAX_INPUT:
        raise DocumentError("LIMIT_EXCEEDED", "the file is too large")
    d = _INSPECT[detect(content, name)](content)
    return {"coverage": "full", "checked_pages": None, "image_only_pages": None, "ocr_pixels": None, "ocr_within_budget": None} | d | {"title": d["title"] or _stem(name), "input_bytes": len(content)}


def public_message(error: BaseException) -> str:
    """A message without addresses or paths, short enough to show."""
    said = re.sub(r"\b(?:file|https?|blob):\S+", "[address]", str(error) or type(error).__name__)
    return re.sub(r"\s+", " ", re.sub(r"(?:/[\w.-]+){2,}", "[path]", said)).strip()[:300]


@contextlib.contextmanager
def deadline(seconds: int = policy.TIMEOUT):
    """A document that takes longer is a typed failure. Only where the interpreter can be interrupted: the main thread of a worker process."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise DocumentError("CONVERSION_FAILED", "it took too long")

    old = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def attempt(work, content: bytes | None, name: str) -> tuple[object, str | None, str | None]:
    """(result, None, None) or (None, error code, message): one bad file is one row, whatever is wrong with it."""
    try:
        with deadline():
            if not content:
                raise DocumentError("INVALID_DOCUMENT", "the file is empty")
            return work(content, name), None, None
    except DocumentError as e:
        return None, e.code, public_message(e)
    except archives.Broken as e:
        return None, "DAMAGED_ARCHIVE", public_message(e)
    except (RecursionError, MemoryError, Exception) as e:
        return None, "CONVERSION_FAILED", public_message(e)


_UNITS = "path string, format string, doc_title string, author string, language string, seq long, kind string, title string, markdown string, canonical boolean, assets long, warnings array<string>, repair string, error string"


def units(files: DataFrame) -> DataFrame:
    """``files`` (path, content) to unit rows; a document that fails is one row with its error code."""
    schema = StructType.fromDDL(_UNITS)
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def rows_of(batches):
        for batch in pieces(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d, code, _ = attempt(read_document, content.as_py(), path or "")
                if d is None:
                    yield path, *[None] * 12, code
                else:
                    kind = "page" if d["format"] == "pdf" else "chapter"
                    yield from ((path, d["format"], d["title"], d["author"], d["language"], u["seq"], kind, u["title"], u["raw"], u["canonical"], len(d["assets"]), d["warnings"], d["repair"] and d["repair"]["level"], None) for u in d["units"])

    return files.select("path", "content").mapInArrow(lambda batches: gathered(rows_of(batches), names, types), schema)


_INSPECTED = "path string, format string, title string, author string, language string, units long, unit_label string, graphics long, input_bytes long, processed_bytes long, coverage string, checked_pages long, image_only_pages long, ocr_pixels long, ocr_within_budget boolean, warnings array<string>, repair struct<level: string, actions: array<string>, original_bytes: long, repaired_bytes: long, omitted: long>, error string, message string"


def inspections(files: DataFrame) -> DataFrame:
    """One preflight row for each of ``files`` (path, content)."""
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(_INSPECTED)}

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d, code, message = attempt(inspect_document, content.as_py(), path or "")
                rows.append((d or {}) | {"path": path, "error": code, "message": message})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in types.items()], list(types))

    return files.select("path", "content").mapInArrow(run, _INSPECTED)

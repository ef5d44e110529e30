"""HTML to passive Markdown in Arrow batches: a forgiving tree on the standard parser, then a writer of blocks.

Output: ATX headings, ``-`` bullets, numbered lists, fenced code with its indentation, pipe tables, ``>`` quotes, ``**``, ``*``, ``~~`` and code spans.
Text that would read as markup is escaped, so a page cannot bring in links, headings or emphasis of its own. Images and links only survive through
the given resolvers. At last the text is hardened: addresses are neutralised and angle brackets become entities.

Elements that are left out take their content with them, but never what follows: an end tag closes all that is open inside its element, ``head``
ends where the body's content begins, and options, list items, cells and paragraphs end where the next one begins. Elements nested deeper than ``DEPTH`` are read as
if they stood at that depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.batches import pieces

#: Elements whose content is left out.
IGNORED = frozenset("head script style iframe frame frameset object embed applet form input button select option textarea link meta base math video audio source".split())
VOID = frozenset("area base br col embed frame hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
#: A new element of the first kind ends an open one of the second, unless one of the third stands between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
DEPTH = 150
SCHEME, NOTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:"), re.compile(r"#[A-Za-z0-9_.:-]{1,200}")
_MARKUP = re.compile(r"([\\`*_\[\]~])")
_LINE_START = re.compile(r"^(#{1,6}(?=\s|$)|[-+=](?=\s|$|[-+=])|>)|^(\d{1,9})([.)])(?=\s|$)", re.M)


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def words(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in IGNORED else c.words() for c in self.children)

    def first(self, tag: str) -> Element | None:
        for c in self.children:
            if not isinstance(c, str):
                if c.tag == tag or (c := c.first(tag)):
                    return c
        return None

    def above(self, tag: str) -> Element | None:
        at = self.parent
        while at is not None and at.tag != tag:
            at = at.parent
        return at

    def markup(self) -> str:
        attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + "".join(escape(c, quote=False) if isinstance(c, str) else c.markup() for c in self.children) + f"</{self.tag}>"


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open = [self.root]

    def _close(self, k: int) -> None:
        del self.open[k:]

    def _innermost(self, tags: frozenset, but: frozenset = frozenset()) -> int | None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in but:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and (k := self._innermost(frozenset(["head"]))) is not None:
            self._close(k)
        if tag in ENDS and (k := self._innermost(*ENDS[tag])) is not None:
            self._close(k)
        elif tag in BLOCKS and (k := self._innermost(frozenset(["p"]), frozenset(["table", "td", "th", "button"]))) is not None:
            self._close(k)
        node = Element(tag, dict(attrs), self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if (k := self._innermost(frozenset([tag]))) is not None:
            self._close(k)

    def handle_data(self, data):
        if data.strip() and (k := self._innermost(frozenset(["head"]))) is not None and self.open[-1].tag == "head":
            self._close(k)
        self.open[-1].children.append(data)


class Writer:
    """``image(src)``, ``link(href)`` and ``svg(markup, label)`` give the output path or the name to show, or None."""

    def __init__(self, image: Callable, link: Callable, svg: Callable):
        self.image, self.link, self.svg = image, link, svg
        self.warnings: list[str] = []
        self.refs: list[str] = []

    def inline(self, nodes: list) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(_MARKUP.sub(r"\\\1", re.sub(r"\s+", " ", n)))
            elif n.tag == "svg":
                out.append(self._svg(n))
            elif n.tag in IGNORED or n.tag == "title":
                continue
            elif n.tag == "img":
                out.append(self._image(n))
            elif n.tag == "br":
                out.append("\n")
            elif n.tag in ("code", "kbd", "samp", "tt"):
                words = re.sub(r"\s+", " ", n.words()).strip()
                fence = "`" * (max(map(len, re.findall("`+", words)), default=0) + 1)
                out.append(f"{fence} {words} {fence}" if "`" in words else f"`{words}`" if words else "")
            elif n.tag in MARKS:
                inner = self.inline(n.children)
                bare = inner.strip()
                mark = MARKS[n.tag] if bare else ""
                out.append(inner[: len(inner) - len(inner.lstrip())] + mark + bare + mark + inner[len(inner.rstrip()) :] if bare else inner)
            elif n.tag == "a":
                out.append(self.inline(n.children) + self._link((n.attrs.get("href") or "").strip()))
            else:
                out.append(self.inline(n.children))
        return "".join(out)

    def blocks(self, nodes: list) -> list[str]:
        out: list[str] = []
        run: list = []

        def flush():
            lines = [re.sub(r" +", " ", x).strip() for x in self.inline(run).split("\n")]
            said = "\n".join(lines).strip("\n")
            if said:
                out.append(_LINE_START.sub(lambda m: "\\" + m[1] if m[1] else f"{m[2]}\\{m[3]}", said))
            run.clear()

        for n in nodes:
            if isinstance(n, str) or (n.tag not in BLOCKS and not _holds_blocks(n)):
                run.append(n)
                continue
            flush()
            if n.tag in IGNORED:
                continue
            out += self._block(n)
        flush()
        return out

    def _block(self, n: Element) -> list[str]:
        if re.fullmatch("h[1-6]", n.tag):
            words = " ".join(" ".join(self.blocks(n.children)).split())
            return ["#" * int(n.tag[1]) + " " + words] if words else []
        if n.tag == "hr":
            return ["---"]
        if n.tag == "pre":
            code = n.words().strip("\n").rstrip()
            fence = "`" * max(3, max(map(len, re.findall("`+", code)), default=0) + 1)
            return [f"{fence}\n{code}\n{fence}"]
        if n.tag in ("ul", "ol"):
            return self._list(n)
        if n.tag == "blockquote":
            inner = "\n\n".join(self.blocks(n.children))
            return [text.quoted_lines(inner)] if inner else []
        if n.tag == "table":
            return self._table(n)
        return self.blocks(n.children)

    def _list(self, n: Element) -> list[str]:
        items, number = [], 0
        for c in n.children:
            if isinstance(c, str) and not c.strip():
                continue
            inner = self.blocks([c] if isinstance(c, str) or c.tag != "li" else c.children)
            if not inner:
                continue
            number += 1
            head = f"{number}. " if n.tag == "ol" else "- "
            tight = all(re.match(r"(- |\d+\. )", b) for b in inner[1:])
            body = ("\n" if tight else "\n\n").join(inner)
            items.append(head + body.replace("\n", "\n" + " " * len(head)))
        return ["\n".join(items)] if items else []

    def _table(self, n: Element) -> list[str]:
        rows: list[list[str]] = []

        def visit(node: Element):
            for c in node.children:
                if isinstance(c, str):
                    continue
                if c.tag == "tr":
                    rows.append([" ".join(" ".join(self.blocks(x.children)).split()).replace("|", "\\|") for x in c.children if not isinstance(x, str) and x.tag in ("td", "th")])
                elif c.tag in ("thead", "tbody", "tfoot"):
                    visit(c)
                elif c.tag == "caption":
                    before.extend(self.blocks(c.children))

        before: list[str] = []
        visit(n)
        rows = [r for r in rows if r]
        if not rows:
            return before
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return [*before, "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])]

    def _link(self, href: str) -> str:
        if NOTE.fullmatch(href):
            return f" (see note {text.ESCAPE_LABEL(href)})"
        if href and not href.startswith("//") and not SCHEME.match(href) and (name := self.link(href)):
            return f" (see {text.ESCAPE_LABEL(name)})"
        if href:
            self.warnings.append("A link to another place was removed.")
        return ""

    def _image(self, n: Element) -> str:
        figure = n.above("figure")
        caption = figure.first("figcaption") if figure else None
        said = [n.attrs.get("alt"), caption and caption.words(), n.attrs.get("title"), n.attrs.get("aria-label")]
        label = " - ".join(dict.fromkeys(x for x in map(text.ESCAPE_LABEL, said) if x))[:300] or "Image"
        src = (n.attrs.get("src") or "").strip()
        self.refs.append(src)
        path = None if not src or src.startswith("//") or SCHEME.match(src) else self.image(src)
        if path:
            return f"![{label}]({path})"
        self.warnings.append("An image was removed.")
        return f"[Image removed: {label}]"

    def _svg(self, n: Element) -> str:
        title = n.first("title")
        label = text.ESCAPE_LABEL(title.words() if title else n.attrs.get("aria-label")) or "Inline SVG"
        if path := self.svg(n.markup(), label):
            return f"![{label}]({path})"
        self.warnings.append("An inline SVG was removed.")
        return f"[Image removed: {label}]"


def _holds_blocks(n: Element) -> bool:
    """An inline element around blocks is read as its content."""
    return n.tag not in IGNORED and n.tag != "svg" and any(not isinstance(c, str) and (c.tag in BLOCKS or _holds_blocks(c)) for c in n.children)


def hardened(markdown: str) -> str:
    return text.HARDEN(markdown)


def _lookup(given) -> Callable:
    return given if callable(given) else (given or {}).get


def to_markdown(html: str | None, images=None, links=None, svg: Callable | None = None) -> tuple[str, list[str], list[str]]:
    """Markdown, warnings (distinct, first seen first) and image references. ``images`` and ``links`` are functions or mappings."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    w = Writer(_lookup(images), _lookup(links), svg or (lambda markup, label: None))
    markdown = hardened("\n\n".join(w.blocks(tree.root.children)))
    return markdown, list(dict.fromkeys(w.warnings))[:100], w.refs


def units(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One unit for each page: id, title (first heading), markdown, warnings, images."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            rows = [to_markdown(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["id", "markdown", "warnings", "images"])

    out = pages.select(id_col, html_col).mapInArrow(run, f"id {kind}, markdown string, warnings array<string>, images array<string>")
    return out.select(F.col("id").alias(id_col), F.regexp_extract("markdown", r"(?m)^#{1,6}[ \t]+(.+)$", 1).alias("title"), "markdown", "warnings", "images")

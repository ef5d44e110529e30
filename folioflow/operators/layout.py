"""Positioned text to reading order: lines, columns, headings and paragraphs of a page, font repair, and text runs in page space.

An item is a dict with ``str``, ``x``, ``y``, ``width``, ``height`` and, after a repair, ``repaired``; y grows upwards. The thresholds are fixed values.
"""

from __future__ import annotations

import math
import re
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.batches import pieces

#: Glyph names that broken font maps use, besides single letters and uniXXXX.
GLYPHS = {
    "Euro": "€", "H22073": "□", "arrowdown": "↓", "arrowleft": "←", "arrowright": "→", "arrowup": "↑", "emdash": "—", "endash": "–", "eacute": "é", "uacute": "ú", "hyphen": "-", "lalt": "l", "minus": "−", "multiply": "×",
    "onequarter": "¼", "threequarters": "¾", "parenleft": "(", "parenright": ")", "periodcentered": "·", "plus": "+", "quotedblleft": "“", "quotedblright": "”", "quoteleft": "‘", "quoteright": "’", "radical": "√", "slash": "/", "space": " ",
}
for _n, _name in enumerate("zero one two three four five six seven eight nine".split()):
    GLYPHS |= {_name: str(_n), _name + "inferior": chr(0x2080 + _n), _name + "superior": {1: "¹", 2: "²", 3: "³"}.get(_n, chr(0x2070 + _n))}
_SUFFIX = re.compile(r"(?:\.(?:alt\d*|lin|sc|titl))+$")


def glyph_text(name: str) -> str | None:
    """The character of a glyph name, or None: unknown names are not guessed."""
    name = _SUFFIX.sub("", name)
    if name in GLYPHS:
        return GLYPHS[name]
    if re.fullmatch("[A-Za-z]", name):
        return name
    if m := re.fullmatch("(?:uni|u)([0-9A-Fa-f]{4,6})", name):
        code = int(m[1], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None
    return None


def font_repairs(differences: dict[int, str]) -> dict[str, str]:
    """What each wrongly mapped character of a font stands for, from its code's glyph name."""
    found = {chr(code): glyph_text(name) for code, name in differences.items() if 0 <= code <= 0xFFFF}
    return {c: new for c, new in found.items() if new is not None and new != c}


def repaired_items(items: list[dict], repairs: dict[str, dict[str, str]]) -> tuple[list[dict], int, int]:
    """Items with the characters of their ``font`` repaired, and the numbers of fonts and of characters concerned."""
    out, fonts, glyphs = [], set(), 0
    for item in items:
        own = repairs.get(item.get("font") or "", {})
        n = sum(c in own for c in item["str"]) if own else 0
        if n:
            fonts.add(item["font"])
            glyphs += n
            item = item | {"str": "".join(own.get(c, c) for c in item["str"]), "repaired": True}
        out.append(item)
    return out, len(fonts), glyphs


def joined(line: str, token: str) -> str:
    """A blank between them, but for closing and after opening punctuation."""
    if not line:
        return token
    tight = token[0] in ",.;:!?%)}]" or line[-1] in "([{„“'/-"
    return line + token if tight else f"{line} {token}"


def _tokens(items: list[dict]) -> list[dict]:
    out = []
    for item in items:
        said = item.get("str") or ""
        words = text.METADATA(said, 20_000)
        if words:
            height = item.get("height") or 0
            height = height if math.isfinite(height) and height > 0 else 12.0
            width = item.get("width")
            width = width if width is not None and math.isfinite(width) and width >= 0 else len(words) * height * 0.48
            out.append({"text": words, "x": float(item.get("x") or 0), "y": float(item.get("y") or 0), "width": width, "height": height, "open": not said[0].isspace(), "shut": not said[-1].isspace(), "repaired": bool(item.get("repaired"))})
    return out


def _before(a: dict, b: dict) -> float:
    """Higher first; at much the same height, further left first."""
    return b["y"] - a["y"] if abs(b["y"] - a["y"]) > 0.45 * max(a["height"], b["height"]) else a["x"] - b["x"]


def lines_of(items: list[dict]) -> list[dict]:
    """Lines (``text``, ``x``, ``end``, ``y``, ``height``), each cut where a wide gap parts columns."""
    rows: list[list[dict]] = []
    for t in sorted(_tokens(items), key=cmp_to_key(_before)):
        if rows and abs(rows[-1][0]["y"] - t["y"]) <= 0.55 * max(rows[-1][0]["height"], t["height"]):
            rows[-1].append(t)
        else:
            rows.append([t])
    out = []
    for row in rows:
        parts: list[list[dict]] = []
        for t in sorted(row, key=lambda t: t["x"]):
            last = parts[-1][-1] if parts else None
            if last is None or t["x"] - last["x"] - last["width"] > max(72, 6 * last["height"], 6 * t["height"]):
                parts.append([t])
            else:
                parts[-1].append(t)
        out += map(_line, parts)
    return out


def _line(part: list[dict]) -> dict:
    said, last = "", None
    for t in part:
        if last is not None and (last["repaired"] or t["repaired"]) and last["shut"] and t["open"]:
            near = max(1.5, 0.16 * min(last["height"], t["height"]))
            said = said + t["text"] if abs(t["x"] - last["x"] - last["width"]) <= near else joined(said, t["text"])
        else:
            said = joined(said, t["text"])
        last = t
    return {"text": said, "x": min(t["x"] for t in part), "end": max(t["x"] + t["width"] for t in part), "y": sum(t["y"] for t in part) / len(part), "height": max(t["height"] for t in part)}


def in_order(lines: list[dict], width: float) -> tuple[list[dict], int]:
    """Reading order and the number of columns (1 or 2). A short line in the middle of a page of two columns counts for both sides."""
    if not width > 0 or len(lines) < 8:
        return lines, 1
    left = [x for x in lines if x["end"] < 0.56 * width]
    right = [x for x in lines if x["x"] > 0.44 * width]
    across = [x for x in lines if x not in left and x not in right]
    if len(left) < 3 or len(right) < 3 or len(across) > 0.45 * len(lines):
        return lines, 1
    top, bottom = max(x["y"] for x in left + right), min(x["y"] for x in left + right)
    zone = {id(x): 0 if x["y"] >= top else 4 if x["y"] <= bottom else 2 for x in across}
    placed = [(zone[id(x)], x) for x in across] + [(1, x) for x in left] + [(3, x) for x in right]
    return [x for _, x in sorted(placed, key=lambda p: (p[0], -p[1]["y"]))], 2


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2] if values else 12.0


def page_text(items: list[dict], width: float) -> dict:
    """``plain``, ``markdown``, ``lines``, ``columns`` and ``headings`` of a page."""
    lines, columns = in_order(lines_of(items), width)
    body = upper_median([x["height"] for x in lines])
    parts: list[tuple[str, bool]] = []
    last = None
    for line in lines:
        heading = line["height"] >= 1.42 * body and 2 <= len(line["text"]) <= 160 and line["text"][-1] not in ".!?"
        apart = last is not None and abs(last["y"] - line["y"]) > 1.72 * max(last["height"], line["height"])
        if parts and not apart and not heading and not parts[-1][1] and parts[-1][0].endswith("-") and line["text"][0].islower():
            parts[-1] = (parts[-1][0][:-1] + line["text"], False)
        else:
            parts += [("", False)] * apart + [(line["text"], heading)]
        last = line
    shown = [("### " if h and t else "") + text.ESCAPE_PDF(t) for t, h in parts]
    closed = lambda x: re.sub(r"\n{3,}", "\n\n", "\n".join(x)).strip()
    return {"plain": closed([t for t, _ in parts]), "markdown": closed(shown), "lines": len(lines), "columns": columns, "headings": sum(h for _, h in parts)}


Matrix = tuple[float, float, float, float, float, float]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The affine map that applies ``b``, then ``a``."""
    return (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def product_columns(a: list, b: list) -> list:
    """``product`` for two lists of six columns."""
    return [a[i % 2] * b[i // 2 * 2] + a[i % 2 + 2] * b[i // 2 * 2 + 1] + (a[i % 2 + 4] if i > 3 else 0) for i in range(6)]


def text_runs(items: list[dict], viewport: Matrix, page_height: float) -> list[tuple[str, Matrix]]:
    """Text and page matrix of each item (``matrix``, ``width``, ``height``): unit vectors along the baseline by the advance of a character, across it by the height."""
    out = []
    for item in items:
        said = text.SEARCH(item.get("str"))
        if not said or not page_height > 0:
            continue
        m = product(viewport, item["matrix"])
        m = (m[0], -m[1], m[2], -m[3], m[4], page_height - m[5])
        along, across = math.hypot(m[0], m[1]), math.hypot(m[2], m[3])
        if along == 0:
            continue
        step, rise = max(abs(item.get("width") or 0) / len(said), 0.01), max(abs(item.get("height") or 0), across, along, 0.01)
        ux, uy = m[0] / along, m[1] / along
        vx, vy = (m[2] / across, m[3] / across) if across else (-uy, ux)
        out.append((said, tuple(x + 0.0 for x in (ux * step, uy * step, vx * rise, vy * rise, m[4], m[5]))))
    return out


def ocr_runs(words: list[dict], scale: float, page_height: float) -> list[tuple[str, Matrix]]:
    """Text and page matrix of recognised words (``text``, ``x``, ``y``, ``width``, ``height`` in pixels, y downwards)."""
    return [(w["text"], (w["width"] / scale / max(1, len(w["text"])), 0.0, 0.0, w["height"] / scale, w["x"] / scale, page_height - (w["y"] + w["height"]) / scale)) for w in words]


#: One page a row.
ITEMS = "array<struct<str: string, x: double, y: double, width: double, height: double>>"


def pages(rows: DataFrame, id_col: str, items_col: str, width_col: str) -> DataFrame:
    """id, ``plain``, ``markdown``, ``lines``, ``columns``, ``headings`` of rows with a page's items and width, in pieces of Arrow batches."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            found = [page_text(items or [], width or 0.0) for items, width in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            types = {"plain": pa.string(), "markdown": pa.string(), "lines": pa.int64(), "columns": pa.int64(), "headings": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], t) for k, t in types.items()]], ["id", *types])

    out = rows.select(F.col(id_col), F.col(items_col).cast(ITEMS), F.col(width_col).cast("double"))
    return out.mapInArrow(run, f"id {kind}, plain string, markdown string, lines long, columns long, headings long").withColumnRenamed("id", id_col)

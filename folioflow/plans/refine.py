"""Whole documents to output files and bundles, one document a row of the input: ``inspect``, ``outputs``, ``manifest``, ``bundles``, ``contract``.

A document is parsed once, in the task that holds it; selection, titles, media types, sizes and digests of ``outputs`` and ``manifest`` are columns that Catalyst sees.
A bundle is built where its document was parsed, so no file is shuffled. Keep Arrow batches small for large files (``spark.sql.execution.arrow.maxRecordsPerBatch``).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .. import policy
from ..functions import paths, text
from ..functions.batches import gathered, pieces
from ..operators import book
from ..policy import DocumentError
from ..sources import archives, ebooks, pdf

inspect = ebooks.inspections


def converted(content: bytes, name: str, wanted: Callable[[str], object] = lambda path: True) -> tuple[dict[str, bytes], dict]:
    """All files that can be made of a document, or those of them that are wanted, under their internal paths, and its summary."""
    d = ebooks.read_document(content, name)
    meta = {"title": d["title"], "author": d["author"], "language": d["language"], "format": d["format"]}
    files = _of_pages(d, meta) if d["format"] == "pdf" else _of_chapters(d, meta)
    warnings = list(d["warnings"])
    if n := files.pop("findings", 0):
        warnings.append(f"{n} passages read like instructions; they are listed in the safety report.")
    summary = meta | {"units": len(d["units"]), "unit_label": "pages" if d["format"] == "pdf" else "chapters", "assets": len(d["assets"]), "input_bytes": len(content), "processed_bytes": d["bytes"], "warnings": ebooks.distinct(warnings), "repair": d["repair"], "glyphs": d.get("glyphs", 0), "repaired_pages": d.get("repaired_pages", 0)}
    if d["repair"]:
        files["REPAIR-REPORT.md"] = book.repair_report(name, d["repair"], d["copy"] is not None)
        if d["copy"] is not None:
            files["repair/source.repaired." + ("epub" if d["format"] == "epub" else "fb2.zip")] = d["copy"]
    files["SECURITY-REPORT.md"] = book.security_report(summary, posixpath.basename(name))
    made = {k: v() if callable(v) else v for k, v in files.items() if wanted(k)}
    return {k: v.encode() if isinstance(v, str) else v for k, v in made.items()}, summary


def _of_chapters(d: dict, meta: dict) -> dict:
    figures = {f["path"]: f for f in d["assets"]}
    occurrences: list[dict] = []
    chapters = []
    for u in d["units"]:
        marked, found = book.annotated(u["raw"], u["seq"], u["title"], figures)
        occurrences += found
        chapters.append(u | {"annotated": marked})
    head = [f"# {text.INLINE(meta['title'])}"] + [f"**{k.capitalize()}:** {text.INLINE(meta[k])}" for k in ("author", "language") if meta[k]]
    found = book.findings_of(chapters)
    files: dict = {f["path"]: f["data"] for f in d["assets"]}
    files |= {f"chapters/{c['seq']:03d}-{c['title']}.md": book.up_one(c["annotated"]) for c in chapters}
    files["book.md"] = "\n\n---\n\n".join(["\n\n".join(head), *[c["annotated"] for c in chapters]]) + "\n"
    # these two are made only where they are wanted
    files["notebooklm/book.md"] = lambda: book.canonical_book(meta, chapters, d["assets"], occurrences)
    files["notebooklm/book.sanitized.epub"] = lambda: archives.canonical(book.passive_epub(meta, chapters, d["assets"], occurrences))
    files["notebooklm/FIGURE-INDEX.md"] = book.figure_index(meta["title"], d["assets"], occurrences, chapters)
    files["notebooklm/LLM-SAFETY-REPORT.md"] = book.safety_report(found)
    files["notebooklm/README.md"] = book.readme(meta)
    return files | {"findings": len(found)}


def _of_pages(d: dict, meta: dict) -> dict:
    pages = {p["number"]: f"## {p['id']} - Page {p['number']}\n\n{p['markdown'] or '[No text on this page]'}" for p in d["pages"]}
    head = [f"# {text.ESCAPE_PDF(meta['title'])}"] + ([f"**Author:** {text.ESCAPE_PDF(meta['author'])}"] if meta["author"] else []) + ["**Source:** text of a PDF file, page by page"]
    listed = "\n".join(f"- {text.ESCAPE_PDF(t)} - PAGE-{p:04d}" for t, p in d["outline"])
    parts = ["\n\n".join(head)] + ([f"## Document outline\n\n{listed}"] if listed else []) + list(pages.values())
    whole = "\n\n---\n\n".join(parts) + "\n"
    files = {"document.md": whole, "notebooklm/document.md": whole, "notebooklm/README.md": book.readme(meta)}
    files |= {f"pages/PAGE-{k:04d}.md": page + "\n" for k, page in pages.items()}
    if listed:
        files["OUTLINE.md"] = f"# Outline\n\n{listed}\n"
    for k, title, first, last in pdf.sections(d["outline"], len(pages)):
        name = text.safe_name(title, f"Section {k}")
        files[f"sections/{k:03d}-{name}.md"] = f"# {text.ESCAPE_PDF(title)}\n\n" + "\n\n---\n\n".join(pages[p] for p in range(first, last + 1)) + "\n"
    return files


def selected(files: dict[str, bytes], title: str, outputs, profile: str) -> dict[str, bytes]:
    """The files of a selection under the title's names, in order; two files of one name are a failure."""
    stem = text.safe_name(title, "Untitled book")
    out: dict[str, bytes] = {}
    for path in sorted((p for p in files if paths.is_kept(p, outputs, profile)), key=lambda p: paths.collation_key(paths.is_titled(p, stem))):
        shown = paths.is_titled(path, stem)
        if shown in out:
            raise DocumentError("CONVERSION_FAILED", "two files have one name")
        out[shown] = files[path]
    return out


def manifest_text(files: list[dict], summary: dict, outputs, profile: str) -> str:
    """The export manifest: what was read, what was selected, and size and SHA-256 of each file."""
    repair = summary["repair"] and {"level": summary["repair"]["level"], "actions": summary["repair"]["actions"], "originalBytes": summary["repair"]["original_bytes"], "repairedBytes": summary["repair"]["repaired_bytes"], "omittedEntries": summary["repair"]["omitted"]}
    source = {"format": summary["format"], "title": summary["title"], "author": summary["author"], "language": summary["language"], "inputBytes": summary["input_bytes"], "repair": repair}
    output = {"units": summary["units"], "unitLabel": summary["unit_label"], "sanitizedGraphics": summary["assets"], "files": [{"path": f["path"], "mediaType": f["media_type"], "bytes": f["bytes"], "sha256": f["sha256"]} for f in files]}
    whole = {"schemaVersion": 2, "generator": book.GENERATOR, "profile": profile, "selectedOutputs": list(outputs), "source": {k: v for k, v in source.items() if v is not None}, "output": output}
    return json.dumps(whole, indent=2, ensure_ascii=False) + "\n"


def bundle_name(title: str, profile: str) -> str:
    return f"{text.safe_name(title, 'Untitled book')}-{'safe-archive' if profile == 'archive' else profile}.zip"


def chosen(outputs=None, profile: str | None = None) -> tuple[tuple[str, ...], str]:
    """Outputs and the name of the profile they make; a wrong name is an error before any job starts."""
    groups = {g for own in policy.PROFILES.values() for g in own}
    if outputs is None:
        if profile not in policy.PROFILES:
            raise ValueError(f"profile {profile!r}: one of {sorted(policy.PROFILES)} is needed")
        return policy.PROFILES[profile], profile
    if not outputs or not set(outputs) <= groups:
        raise ValueError(f"outputs {outputs!r}: some of {sorted(groups)} are needed")
    return tuple(outputs), policy.profile_of(outputs)


_OUTPUTS = "path string, doc_title string, file string, data binary, error string, message string"


def outputs(files: DataFrame, outputs=None, profile: str | None = "archive") -> DataFrame:
    """``files`` (path, content) to a row for each selected output file: ``path``, ``file``, ``media_type``, ``bytes``, ``sha256``, ``data``; a document that fails is one row with its error."""
    groups, name = chosen(outputs, profile)
    schema = StructType.fromDDL(_OUTPUTS)
    types = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def rows_of(batches):
        for batch in pieces(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made, code, message = ebooks.attempt(lambda data, at: converted(data, at, lambda p: paths.is_kept(p, groups, name)), content.as_py(), path or "")
                yield from ((path, made[1]["title"], k, v, None, None) for k, v in made[0].items()) if made else [(path, None, None, None, code, message)]

    made = files.select("path", "content").mapInArrow(lambda batches: gathered(rows_of(batches), names, types), schema)
    kept = made.where(F.col("error").isNotNull() | paths.kept(F.col("file"), F.array(*map(F.lit, groups)), F.lit(name)))
    file = paths.titled(F.col("file"), text.output_name(F.col("doc_title"), "Untitled book"))
    return kept.select("path", file.alias("file"), paths.by_extension(F.col("file"), paths.MEDIA, "application/octet-stream").alias("media_type"), F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"), "data", "error", "message")


def manifest(files: DataFrame) -> DataFrame:
    """The inventory of ``outputs`` rows: ``path``, ``place`` (in the order of the root collation), ``file``, ``media_type``, ``bytes``, ``sha256``."""
    rows = files.where("error is null").drop("data")
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.collate("file", "UNICODE"), "file")).cast("long")
    return rows.select("path", place.alias("place"), "file", "media_type", "bytes", "sha256")


_BUNDLES = "path string, filename string, archive binary, format string, title string, units long, assets long, output_bytes long, preview string, warnings array<string>, files array<struct<path: string, media_type: string, bytes: long, sha256: string>>, manifest string, error string, message string"


def bundled(content: bytes, name: str, groups, profile: str) -> dict:
    import hashlib

    made, summary = converted(content, name, lambda p: p in ("book.md", "document.md") or paths.is_kept(p, groups, profile))  # the preview needs the first two
    files = selected(made, summary["title"], groups, profile)
    listed = [{"path": p, "media_type": paths.media_of(p), "bytes": len(x), "sha256": hashlib.sha256(x).hexdigest()} for p, x in files.items()]
    said = manifest_text(listed, summary, groups, profile)
    files[f"{text.safe_name(summary['title'], 'Untitled book')}.export-manifest.json"] = said.encode()
    archive = archives.canonical(files)
    if len(archive) > policy.MAX_OUTPUT:
        raise DocumentError("LIMIT_EXCEEDED", "the bundle is too large")
    preview = next((made[k] for k in ("book.md", "document.md") if k in made), b"").decode()[: policy.PREVIEW]
    return {"filename": bundle_name(summary["title"], profile), "archive": archive, "format": summary["format"], "title": summary["title"], "units": summary["units"], "assets": summary["assets"], "output_bytes": len(archive), "preview": preview, "warnings": summary["warnings"], "files": listed, "manifest": said}


def bundles(files: DataFrame, outputs=None, profile: str | None = "archive") -> DataFrame:
    """One row for each of ``files`` (path, content): the deterministic ZIP of the selected outputs with its manifest, or the error."""
    groups, name = chosen(outputs, profile)
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(_BUNDLES)}

    def rows_of(batches):
        for batch in pieces(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made, code, message = ebooks.attempt(lambda data, at: bundled(data, at, groups, name), content.as_py(), path or "")
                row = (made or {}) | {"path": path, "error": code, "message": message}
                yield tuple(row.get(k) for k in types)

    return files.select("path", "content").mapInArrow(lambda batches: gathered(rows_of(batches), list(types), list(types.values())), _BUNDLES)


def batches(made: DataFrame, size: int = policy.MAX_BATCH) -> DataFrame:
    """Bundles gathered into outer archives of ``size`` documents at most: ``batch`` and ``archive``, whose members are numbered in the order of paths.
    Numbers come from a sort by ranges and the counts of its partitions, so no task holds more than one batch."""
    rows = made.where("error is null").select("path", "filename", "archive")
    keys = rows.select("path").distinct().sort("path").withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    counts = keys.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each partition
    numbered = keys.join(F.broadcast(before), "part").select("path", (F.col("k") + F.col("before")).alias("n"))
    placed = rows.join(numbered, "path").withColumn("batch", F.expr(f"n div {size}"))

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["n", "filename", "archive"]).to_pylist(), key=lambda r: r["n"])
        members = {f"{k:02d}-{r['filename']}": r["archive"] for k, r in enumerate(rows, 1)}
        return pa.table({"batch": table.column("batch")[:1], "archive": pa.array([archives.stored(members)], pa.binary())})

    return placed.select("batch", "n", "filename", "archive").groupBy("batch").applyInArrow(pack, "batch long, archive binary")


#: Fixed values: (group, format or *, file, kind, may be missing) of what a selection promises.
CONTRACT = (
    ("visual-source", "pdf", "notebooklm/{title}.sanitized.pdf", "PDF", True),
    ("visual-source", "ebook", "notebooklm/{title}.sanitized.epub", "EPUB", False),
    ("visual-source", "*", "notebooklm/README.md", "Markdown", False),
    ("markdown", "*", "{title}.md", "Markdown", False),
    ("chunks", "pdf", "pages/PAGE-*.md", "Markdown", False),
    ("chunks", "pdf", "sections/*.md", "Markdown", True),
    ("chunks", "pdf", "{title}.outline.md", "Markdown", True),
    ("chunks", "ebook", "chapters/*.md", "Markdown", False),
    ("assets", "pdf", "notebooklm/{title}.sanitized.pdf", "PDF", True),
    ("assets", "ebook", "assets/*.{png,jpg,gif,webp,svg}", "Images", True),
    ("assets", "ebook", "notebooklm/{title}.figure-index.md", "Markdown", False),
    ("archive", "*", "notebooklm/{title}.md", "Markdown", False),
    ("*", "*", "{title}.security-report.md", "Markdown", False),
    ("*", "*", "{title}.export-manifest.json", "JSON", False),
    ("*", "ebook", "notebooklm/{title}.llm-safety-report.md", "Markdown", False),
    ("*", "*", "{title}.repair-report.md", "Markdown", True),
    ("*", "ebook", "repair/{title}.repaired.*", "EPUB or FB2 ZIP", True),
)


def contract(spark: SparkSession) -> DataFrame:
    """``profile``, ``format``, ``file``, ``kind``, ``optional``: what each profile promises for each format, each file once."""
    specs = spark.createDataFrame([(k, *c) for k, c in enumerate(CONTRACT)], "place int, part string, of string, file string, kind string, optional boolean")
    wanted = [(p, fmt, part, fmt if fmt == "pdf" else "ebook") for p, own in policy.PROFILES.items() for fmt in ("epub", "fb2", "pdf") for part in (*own, "*", *(["archive"] if p == "archive" else []))]
    wanted = spark.createDataFrame(wanted, "profile string, format string, part string, own string")
    rows = wanted.join(F.broadcast(specs), "part").where("of = '*' or of = own")
    first = F.row_number().over(Window.partitionBy("profile", "format", "file").orderBy("place"))
    return rows.withColumn("first", first).where("first = 1").select("profile", "format", "file", "kind", "optional")


def needs_pages_rendered(outputs, document_format: str) -> bool:
    """Whether a selection asks for the visual companion of a PDF."""
    return document_format == "pdf" and bool({"visual-source", "assets"} & set(outputs))

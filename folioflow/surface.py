"""What SQL users get: functions, table functions and the ``docbundle`` data source, by ``register(spark)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import policy
from .functions import text
from .operators import html, layout, svg
from .sources import archives, ebooks


def _of_text(work):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else work(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def _passive(data: str) -> str | None:
    try:
        return svg.sanitized(data.encode())[0].decode()
    except policy.DocumentError:
        return None


def _layout(items: pd.Series, width: pd.Series) -> pd.Series:
    plain = lambda x: [] if x is None else [i if isinstance(i, dict) else i.asDict() for i in x]
    return pd.Series([layout.page_text(plain(i), w or 0.0)["markdown"] for i, w in zip(items, width, strict=True)], dtype=object)


FUNCTIONS = {
    "safe_markdown": lambda: _of_text(html.hardened),
    "html_to_markdown": lambda: _of_text(lambda v: html.to_markdown(v)[0]),
    "sanitize_svg": lambda: _of_text(_passive),
    "safe_output_name": lambda: _of_text(lambda v: text.safe_name(v, "document")),
    "nfkc": lambda: _of_text(text.Text((), "", 0, True)),
    "page_layout": lambda: F.pandas_udf(_layout, "string"),
}


@F.udtf(returnType="entry_idx: bigint, entry: string, data: binary, repair: string, error: string")
class ZipEntries:
    """Entries of an archive, or one row with an error code."""

    def eval(self, content: bytes):
        found, code, _ = ebooks.attempt(lambda data, _: archives.open_recoverable(data), content, "")
        if found is None:
            yield None, None, None, None, code
        else:
            entries, repair = found
            for k, (name, data) in enumerate(entries.items()):
                yield k, name, data, repair and repair["level"], None


_UNIT = "seq: bigint, title: string, markdown: string, canonical: boolean, error: string"


def _units(content: bytes, read):
    d, code, _ = ebooks.attempt(lambda data, _: read(data), content, "")
    if d is None:
        yield None, None, None, None, code
    else:
        for u in d["units"]:
            yield u["seq"], u["title"], u["raw"], u["canonical"], None


@F.udtf(returnType=_UNIT)
class EpubUnits:
    def eval(self, content: bytes):
        yield from _units(content, ebooks.read_epub)


@F.udtf(returnType=_UNIT)
class Fb2Units:
    def eval(self, content: bytes):
        yield from _units(content, ebooks.read_fb2)


@F.udtf(returnType=_UNIT)
class PdfPages:
    def eval(self, content: bytes):
        yield from _units(content, ebooks.read_pdf)


TABLE_FUNCTIONS = {"zip_entries": ZipEntries, "epub_units": EpubUnits, "fb2_units": Fb2Units, "pdf_pages": PdfPages}


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Documents of a folder that all executors see; files are dealt to partitions by size."""

    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task = folder, per_task

    def partitions(self):
        found = [(os.path.getsize(p), p) for base, _, names in os.walk(self.folder) for n in sorted(names) if (p := os.path.join(base, n)).lower().endswith((".epub", ".fb2", ".fb2.zip", ".pdf"))]
        parts: list[list[str]] = [[]]
        size = 0
        for n, path in sorted(found, key=lambda x: x[1]):
            if parts[-1] and size + n > self.per_task:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            if not 1 <= os.path.getsize(path) <= policy.MAX_INPUT:
                yield path, None, None, None, None, None, "LIMIT_EXCEEDED" if os.path.getsize(path) else "INVALID_DOCUMENT"
                continue
            with open(path, "rb") as f:
                d, code, _ = ebooks.attempt(ebooks.read_document, f.read(), path)
            if d is None:
                yield path, None, None, None, None, None, code
            else:
                for u in d["units"]:
                    yield path, d["format"], d["title"], u["seq"], u["title"], u["raw"], None


class _Done(WriterCommitMessage):
    def __init__(self, written: list[tuple[str, str]]):
        self.written = written


class _Writer(DataSourceWriter):
    """Rows (filename, archive) as files. A task writes under names of its own; the driver renames them when all tasks are done, so a retried task leaves nothing behind."""

    def __init__(self, folder: str, schema: StructType):
        if not {"filename", "archive"} <= set(schema.names):
            raise ValueError("columns filename and archive are needed")
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> _Done:
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        written = []
        for r in rows:
            if r["archive"] is not None and r["filename"]:
                name = text.safe_name(os.path.basename(r["filename"]), "bundle.zip")
                own = f".{uuid.uuid4().hex}.part"
                with open(os.path.join(self.folder, own), "wb") as f:
                    f.write(bytes(r["archive"]))
                written.append((own, name))
        return _Done(written)

    def commit(self, messages):
        used = set(os.listdir(self.folder)) if os.path.isdir(self.folder) else set()
        for own, name in sorted((w for m in messages if m for w in m.written), key=lambda w: (w[1], w[0])):
            stem, ext = os.path.splitext(name)
            k, free = 1, name
            while free in used:
                k, free = k + 1, f"{stem} ({k + 1}){ext}"
            used.add(free)
            os.replace(os.path.join(self.folder, own), os.path.join(self.folder, free))

    def abort(self, messages):
        for own, _ in (w for m in messages if m for w in m.written):
            if os.path.exists(path := os.path.join(self.folder, own)):
                os.remove(path)


class DocBundle(DataSource):
    """``spark.read.format("docbundle").load(folder)``: chapters and pages; ``df.write.format("docbundle").mode("append").save(folder)``: a file for each bundle."""

    @classmethod
    def name(cls) -> str:
        return "docbundle"

    def schema(self) -> str:
        return "path string, format string, doc_title string, seq bigint, title string, markdown string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("bytespertask", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the functions, table functions and the data source known to the session."""
    for name, make in FUNCTIONS.items():
        spark.udf.register(name, make())
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    spark.dataSource.register(DocBundle)

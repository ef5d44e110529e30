"""ZIP archives: strict scan with limits, verifiable repair, canonical writing. Parsing runs in Arrow batches, a failure is a row."""

from __future__ import annotations

import io
import re
import struct
import unicodedata
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import policy
from ..functions import paths
from ..functions.batches import gathered, pieces
from ..policy import DocumentError

_LOCAL, _CENTRAL = b"PK\x03\x04", b"PK\x01\x02"
FIXED_DATE = (2026, 1, 1, 0, 0, 0)


def entry_name(path: str) -> str:
    """The NFC path if it is safe."""
    bare = path[:-1] if path.endswith("/") else path
    parts = bare.split("/")
    if not path or "\0" in path or "\\" in path or path.startswith("/") or re.match("[A-Za-z]:", path) or any(p in ("", ".", "..") for p in parts):
        raise DocumentError("UNSAFE_ARCHIVE", "unsafe path in the archive")
    bare = unicodedata.normalize("NFC", bare)
    if len(bare) > policy.MAX_PATH or any(len(p) > policy.MAX_SEGMENT for p in bare.split("/")):
        raise DocumentError("UNSAFE_ARCHIVE", "path too long")
    return bare


class Gate:
    """Limits over the entries of one archive."""

    def __init__(self):
        self.count, self.total, self.seen = 0, 0, set()

    def admit(self, path: str, size: int, packed: int) -> str:
        self.count += 1
        if self.count > policy.MAX_ENTRIES:
            raise DocumentError("LIMIT_EXCEEDED", "too many entries")
        name = entry_name(path)
        if (folded := name.casefold()) in self.seen:
            raise DocumentError("UNSAFE_ARCHIVE", "two entries have one path")
        self.seen.add(folded)
        self.total += size
        if size > policy.MAX_ENTRY or self.total > policy.MAX_ENTRIES_TOTAL:
            raise DocumentError("LIMIT_EXCEEDED", "entries too large")
        if size >= policy.RATIO_FROM and size / max(packed, 1) > policy.MAX_RATIO:
            raise DocumentError("UNSAFE_ARCHIVE", "suspicious compression ratio")
        return name


def inflate(raw: bytes, method: int, size: int) -> bytes:
    """Stored or deflated data, never more than the declared size."""
    if method == 0:
        data = raw
    elif method == 8:
        d = zlib.decompressobj(-15)
        try:
            data = d.decompress(raw, size + 1)
        except zlib.error as e:
            raise DocumentError("DAMAGED_ARCHIVE", "compressed data is damaged") from e
    else:
        raise DocumentError("UNSUPPORTED_COMPRESSION", f"compression method {method}")
    if len(data) != size:
        raise DocumentError("DAMAGED_ARCHIVE", "an entry's size does not fit")
    return data


class Broken(Exception):
    """The directory cannot be read: the only failure that repair may follow."""


def open_strict(content: bytes) -> dict[str, bytes]:
    if len(content) < 4 or content[:2] != b"PK" or content[2] not in (3, 5, 7) or content[3] not in (4, 6, 8):
        raise DocumentError("INVALID_DOCUMENT", "not a ZIP archive")
    gate, out = Gate(), {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                name = gate.admit(info.orig_filename, info.file_size, info.compress_size)
                if info.orig_filename.endswith("/"):
                    continue
                if info.flag_bits & 1:
                    raise DocumentError("UNSUPPORTED_DOCUMENT", "encrypted entry")
                if info.compress_type not in (0, 8):
                    raise DocumentError("UNSUPPORTED_COMPRESSION", f"compression method {info.compress_type}")
                out[name] = z.read(info)
    except (zipfile.BadZipFile, struct.error, EOFError, zlib.error, NotImplementedError, ValueError, OSError) as e:
        raise Broken(str(e)) from e
    return out


def _locals(content: bytes):
    """Entries by walking the local headers: (name, data), whether the last is cut off, and what is left over."""
    gate, at, out, cut = Gate(), 0, [], 0
    while content[at : at + 4] == _LOCAL:
        if at + 30 > len(content):
            cut = 1
            break
        flags, method, _, _, crc, packed, size, n, extra = struct.unpack_from("<HHHHIIIHH", content, at + 6)
        if flags & 8:
            raise DocumentError("AMBIGUOUS_REPAIR", "sizes are not in the local headers")
        if flags & 1 or 0xFFFFFFFF in (packed, size):
            raise DocumentError("UNSUPPORTED_DOCUMENT", "encrypted or ZIP64 entry")
        raw_name, begin = content[at + 30 : at + 30 + n], at + 30 + n + extra
        if begin + packed > len(content):
            cut = 1
            break
        path = entry_text(raw_name, flags)
        name = gate.admit(path, size, packed)
        data = _verified(content[begin : begin + packed], method, size, crc)
        if not path.endswith("/"):
            out.append((name, data))
        at = begin + packed
    return out, cut, len(content) - at if not cut else 0


def entry_text(raw: bytes, flags: int) -> str:
    """An entry's name; without the UTF-8 flag only ASCII is certain."""
    try:
        return raw.decode("utf-8" if flags & 0x800 else "ascii")
    except UnicodeDecodeError as e:
        raise DocumentError("AMBIGUOUS_REPAIR", "a name's encoding is unknown") from e


def _directory(content: bytes, start: int) -> list[tuple[str, bytes]] | None:
    """Entries by the directory that begins at ``start``, each matched with its local header; None if it is not a whole directory."""
    gate, at, out, data_end = Gate(), start, [], 0
    while content[at : at + 4] == _CENTRAL:
        if at + 46 > len(content):
            return None
        flags, method, _, _, crc, packed, size, n, extra, comment, disk = struct.unpack_from("<HHHHIIIHHHH", content, at + 8)
        (offset,) = struct.unpack_from("<I", content, at + 42)
        if flags & 1 or disk or 0xFFFFFFFF in (packed, size, offset):
            raise DocumentError("UNSUPPORTED_DOCUMENT", "encrypted, divided or ZIP64 archive")
        name, after = content[at + 46 : at + 46 + n], at + 46 + n + extra + comment
        if after > len(content) or content[offset : offset + 4] != _LOCAL or offset + 30 > len(content):
            return None
        own_flags, own_method = struct.unpack_from("<HH", content, offset + 6)
        own_n, own_extra = struct.unpack_from("<HH", content, offset + 26)
        begin = offset + 30 + own_n + own_extra
        if (own_flags, own_method, content[offset + 30 : offset + 30 + own_n]) != (flags, method, name) or begin + packed > start:
            return None
        data_end = max(data_end, begin + packed)
        path = entry_text(name, flags)
        safe = gate.admit(path, size, packed)
        if not path.endswith("/"):
            out.append((safe, _verified(content[begin : begin + packed], method, size, crc)))
        at = after
    # a directory follows its data, but for a last descriptor; what begins later is the rest of one and would lose entries
    whole = (at == len(content) or content[at : at + 4] == b"PK\x05\x06") and start - data_end <= 24
    return out if out and whole else None


def _verified(raw: bytes, method: int, size: int, crc: int) -> bytes:
    data = inflate(raw, method, size)
    if zlib.crc32(data) != crc:
        raise DocumentError("DAMAGED_ARCHIVE", "an entry's checksum does not fit")
    return data


def _by_directory(content: bytes) -> list[tuple[str, bytes]] | None:
    at, tried = content.find(_CENTRAL), 0
    while at >= 0:
        tried += 1
        if tried > 2 * policy.MAX_ENTRIES:
            raise DocumentError("UNSAFE_ARCHIVE", "too many possible directories")
        if (found := _directory(content, at)) is not None:
            return found
        at = content.find(_CENTRAL, at + 1)
    return None


def repaired(content: bytes) -> tuple[dict[str, bytes], dict]:
    """Entries of a damaged archive, every one verified by size and CRC, and what was done: by a directory that is still whole, else by the local headers."""
    if content[:4] != _LOCAL:
        raise DocumentError("DAMAGED_ARCHIVE", "no entry at the start")
    cut = 0
    if found := _by_directory(content):
        entries, actions = found, [f"The directory and its end were rebuilt from {len(found):,} verified entries."]
    else:
        entries, cut, rest = _locals(content)
        if not entries:
            raise DocumentError("DAMAGED_ARCHIVE", "no entry can be verified")
        actions = [f"The archive was rebuilt from {len(entries):,} verified local entries."]
        if cut:
            actions.append("An incomplete last entry was left out.")
        elif rest:
            actions.append(f"{rest:,} trailing bytes were removed.")
    fixed = canonical(dict(entries))
    if len(fixed) > policy.MAX_INPUT:
        raise DocumentError("LIMIT_EXCEEDED", "the repaired archive is too large")
    return open_strict(fixed), {"level": "salvage" if cut else "automatic", "actions": actions, "original_bytes": len(content), "repaired_bytes": len(fixed), "omitted": cut}


def canonical(entries: dict[str, bytes]) -> bytes:
    """A deterministic archive: ``mimetype`` first and stored, the others sorted, level 6, one fixed date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(entries, key=lambda p: (p != "mimetype", paths.collation_key(p))):
            info = zipfile.ZipInfo(path, FIXED_DATE)
            info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, entries[path], compresslevel=6)
    return out.getvalue()


def stored(entries: dict[str, bytes]) -> bytes:
    """An archive of archives: members as they are, in the order given."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, data in entries.items():
            z.writestr(zipfile.ZipInfo(path, FIXED_DATE), data)
    return out.getvalue()


def open_recoverable(content: bytes) -> tuple[dict[str, bytes], dict | None]:
    try:
        return open_strict(content), None
    except Broken:
        return repaired(content)


def entries(files: DataFrame) -> DataFrame:
    """``files`` (path, content) to a row for each entry, or one row with an error code."""

    def rows_of(batches):
        for batch in pieces(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found, repair = open_recoverable(content.as_py() or b"")
                    yield from ((path, i, name, data, repair and repair["level"], None) for i, (name, data) in enumerate(found.items()))
                except Exception as e:  # one bad file is one row
                    yield path, None, None, None, None, getattr(e, "code", "DAMAGED_ARCHIVE" if isinstance(e, Broken) else "CONVERSION_FAILED")

    def run(batches):
        return gathered(rows_of(batches), ["path", "entry_idx", "entry", "data", "repair", "error"], [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()])

    return files.select("path", "content").mapInArrow(run, "path string, entry_idx long, entry string, data binary, repair string, error string")


def scan(spark, folder: str) -> DataFrame:
    """Accepted document files; the size gate is pushed to the scan, so rejected bytes are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(f"length BETWEEN 1 AND {policy.MAX_INPUT}").where("lower(path) RLIKE '[.](epub|fb2|fb2[.]zip|pdf)$'")

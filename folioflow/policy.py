"""Limits, presets and error codes. They decide which documents are accepted."""

from __future__ import annotations

MIB = 1 << 20
MAX_INPUT, MAX_OUTPUT = 80 * MIB, 300 * MIB
MAX_ENTRIES, MAX_ENTRY, MAX_ENTRIES_TOTAL = 5_000, 25 * MIB, 250 * MIB
MAX_RATIO, RATIO_FROM = 100, 4 * MIB
MAX_XML, MAX_XHTML, MAX_SVG = 2 * MIB, 5 * MIB, 5 * MIB
MAX_FB2, MAX_FB2_BINARY, MAX_FB2_BINARIES = 50 * MIB, 25 * MIB, 100 * MIB
MAX_PDF_PAGES, MAX_PDF_TEXT, MAX_PDF_PAGE_TEXT = 2_000, 30 * MIB, 2 * MIB
MAX_VISUAL_PAGES, MAX_VISUAL_PIXELS = 500, 480_000_000
MAX_OCR_PAGES, MAX_OCR_PIXELS, MAX_OCR_PAGE_PIXELS = 500, 1_500_000_000, 4_500_000
MAX_PATH, MAX_SEGMENT = 1_024, 240
MAX_WARNINGS, MAX_OUTLINE, MAX_BATCH, PREVIEW = 100, 500, 100, 8_000
MAX_PASSWORD, MAX_REPAIRS, MAX_PACKAGES = 1_024, 100, 16
SVG_DEPTH, SVG_NODES = 100, 50_000
XML_DEPTH, TIMEOUT = 200, 120

PROFILES = {"notebooklm": ("visual-source",), "rag": ("markdown", "chunks", "assets"), "markdown": ("markdown", "assets"), "archive": ("visual-source", "markdown", "chunks", "assets")}
CODES = ("INVALID_DOCUMENT", "DAMAGED_ARCHIVE", "UNSUPPORTED_COMPRESSION", "AMBIGUOUS_REPAIR", "LIMIT_EXCEEDED", "UNSAFE_ARCHIVE", "UNSAFE_XML", "UNSUPPORTED_DOCUMENT", "PASSWORD_REQUIRED", "INCORRECT_PASSWORD", "CONVERSION_FAILED")


class DocumentError(Exception):
    """A typed failure of one document; it becomes a row, never a failed job."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def profile_of(outputs) -> str:
    """The preset whose outputs are just these, else ``custom``."""
    return next((name for name, own in PROFILES.items() if set(own) == set(outputs)), "custom")

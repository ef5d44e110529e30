import base64
import io
import random
import struct
import zipfile
import zlib

import duckdb
import pytest

from folioflow import policy
from folioflow.functions import text
from folioflow.operators.html import to_markdown
from folioflow.plans import catalogue
from folioflow.sources import archives, ebooks, pdf

PNG = b"\x89PNG\r\n\x1a\n"
SF = "/root/testdata/sf0.001"


def zipped(entries, level=6):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def epub(chapter="<html><body><h1>First</h1><p>Some text</p><img src='cover.png' alt='Front'/></body></html>", **more):
    opf = '<package><metadata><title>My Book</title><creator>A. Writer</creator><language>de</language></metadata><manifest><item id="c" href="chapter.xhtml" media-type="application/xhtml+xml"/><item id="p" href="cover.png" media-type="image/png"/></manifest><spine><itemref idref="c"/></spine></package>'
    return {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>', "OEBPS/content.opf": opf, "OEBPS/chapter.xhtml": chapter, "OEBPS/cover.png": PNG} | more


def code(f, *a):
    with pytest.raises(policy.DocumentError) as e:
        f(*a)
    return e.value.code


def test_epub_units_and_active_content():
    d = ebooks.read_document(zipped(epub()), "a.epub")
    assert (d["title"], d["author"], d["language"], len(d["units"]), len(d["assets"])) == ("My Book", "A. Writer", "de", 1, 1)
    assert "![Front](assets/FIG-0001-cover.png)" in d["units"][0]["raw"]
    bad = epub("<html><body><p>ok</p><script>evil()</script><a href='javascript:x'>go</a><img src='http://x.test/a.png'/> http://evil.test/</body></html>")
    d = ebooks.read_document(zipped(bad), "a.epub")
    assert "evil" not in d["units"][0]["raw"] and "[external URL removed]" in d["units"][0]["raw"] and d["warnings"]
    assert code(ebooks.read_document, zipped(epub('<!DOCTYPE x [<!ENTITY a "b">]><html/>')), "a.epub") == "UNSAFE_XML"


def test_damaged_archives():
    whole = archives.canonical({k: v if isinstance(v, bytes) else v.encode() for k, v in epub().items()})
    directory = whole.index(b"PK\x01\x02")
    for content, level in ((whole[:directory], "automatic"), (whole[: directory - 1], "salvage")):
        entries, repair = archives.open_recoverable(content)
        assert repair["level"] == level and "mimetype" in entries
    assert code(archives.open_recoverable, zipped({"../x": "a"})) == "UNSAFE_ARCHIVE"
    assert code(archives.open_recoverable, zipped({"a": b"\0" * 5_000_000}, 9)) == "UNSAFE_ARCHIVE"
    assert code(archives.open_recoverable, zipped({"A.txt": "1", "a.TXT": "2"})) == "UNSAFE_ARCHIVE"
    broken = bytearray(whole[:directory])
    struct.pack_into("<H", broken, 6, 8)
    assert code(archives.open_recoverable, bytes(broken)) == "AMBIGUOUS_REPAIR"
    assert code(ebooks.read_document, zipped({k: v for k, v in epub(**{"b.opf": epub()["OEBPS/content.opf"]}).items() if "container" not in k}), "a.epub") in ("AMBIGUOUS_REPAIR", "INVALID_DOCUMENT")


def test_fb2_and_pdf():
    book = f"""<FictionBook xmlns:l="x"><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title><lang>en</lang></title-info></description>
    <body><section><title><p>One</p></title><p>Text <a l:href="#n1">1</a></p><image l:href="#pic"/><section><title><p>Inner</p></title><p>more</p></section></section></body><binary id="pic" content-type="image/png">{base64.b64encode(PNG).decode()}</binary></FictionBook>"""
    d = ebooks.read_document(book.encode(), "a.fb2")
    assert (d["title"], d["author"], len(d["assets"])) == ("T", "A B", 1)
    assert d["units"][0]["title"] == "One" and "## Inner" in d["units"][0]["raw"] and "(see note #n1)" in d["units"][0]["raw"]
    assert ebooks.read_document(zipped({"a.fb2": book}), "a.fb2.zip")["format"] == "fb2"
    assert code(ebooks.read_document, b'<!DOCTYPE x [<!ENTITY a "b">]><FictionBook/>', "a.fb2") == "UNSAFE_XML"
    paper = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]/Count 2>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n4 0 obj<</Length 9>>stream\nBT /F1 12 Tf 72 720 Td (Hello \\(you\\)) Tj 0 -22 Td (http://x.test/) Tj ET\nendstream endobj\n5 0 obj<</Type/Page/Parent 2 0 R>>endobj\ntrailer<</Root 1 0 R>>"
    units = ebooks.read_document(paper, "a.pdf")["units"]
    # addresses are neutralised before the brackets of all text are escaped
    assert [u["title"] for u in units] == ["PAGE-0001", "PAGE-0002"] and units[0]["raw"] == "Hello (you)\n\n\\[external URL removed\\]" and units[1]["raw"] == ""


def packed_pdf(how="flate", more=b"", form=b"BT /F 12 Tf 72 500 Td (within a form) Tj ET"):
    """A file whose catalogue, page tree and page lie in an object stream, with an inline image and a form object."""
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids 8 0 R/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 9 0 R/Resources<</XObject<</X 6 0 R>>>>>>", b"[3 0 R]", b"[4 0 R 5 0 R]"]
    starts = [sum(len(x) + 1 for x in inner[:k]) for k in range(len(inner))]
    table = b" ".join(b"%d %d" % x for x in zip((1, 2, 3, 8, 9), starts, strict=True)) + b" "
    data = table + b"\n".join(inner)
    if how == "rows":  # PNG row filters: each row as its difference from the row above
        rows = [data[k : k + 16].ljust(16) for k in range(0, len(data), 16)]
        data = b"".join(b"\2" + bytes(a - b & 255 for a, b in zip(r, q, strict=True)) for r, q in zip(rows, [bytes(16), *rows], strict=False))
    body = zlib.compress(data)
    kind = {"flate": b"/FlateDecode", "hex": b"[/ASCIIHexDecode /FlateDecode]", "85": b"[/A85 /Fl]", "rows": b"/FlateDecode/DecodeParms<</Predictor 12/Columns 16>>", "other": b"/CryptDecode"}[how]
    body = {"hex": lambda b: b.hex().encode() + b">", "85": lambda b: base64.a85encode(b) + b"~>"}.get(how, lambda b: b)(body)
    return b"".join([
        b"%PDF-1.5\n7 0 obj<</Type/ObjStm/N 5/First ", b"%d" % len(table), b"/Filter", kind, b">>stream\n", body, b"\nendstream endobj\n",
        b"4 0 obj<<>>stream\nq BI /W 1 /H 1 ID (no) Tj EI Q BT /F 12 Tf 72 700 Td (first) Tj ET\nendstream endobj\n",
        b"5 0 obj<<>>stream\nBT /F 12 Tf 72 600 Td (second) Tj ET q 1 0 0 1 0 -100 cm /X Do Q\nendstream endobj\n",
        b"6 0 obj<</Type/XObject/Subtype/Form/Matrix[1 0 0 1 10 0]>>stream\n", form, b"\nendstream endobj\n", more, b"10 0 obj<</Type/XRef/Root 1 0 R>>endobj",
    ])


def test_packed_objects_filters_and_forms():
    for how in ("flate", "hex", "85", "rows"):
        (page,) = pdf.read(packed_pdf(how))["pages"]
        assert [(i["str"], i["x"], i["y"]) for i in page["items"]] == [("first", 72, 700), ("second", 72, 600), ("within a form", 82, 400)], how
    # an appended object replaces the packed one; a form that draws itself and a filter that is not known are typed
    assert pdf.read(packed_pdf(more=b"9 0 obj[5 0 R]endobj\n"))["pages"][0]["items"][0]["str"] == "second"
    assert code(pdf.read, packed_pdf(form=b"/X Do")) == "INVALID_DOCUMENT"
    assert code(pdf.read, packed_pdf("other")) == "UNSUPPORTED_DOCUMENT"
    small = policy.MAX_PDF_PAGE_TEXT * 8
    assert code(pdf._inflated, zlib.compress(bytes(small + 1)), small) == "LIMIT_EXCEEDED" and len(pdf._inflated(zlib.compress(bytes(small)), small)) == small
    assert pdf._from_runs(b"\2abc\xfex\x80zz", 99) == b"abcxxx"


def test_hostile_bytes_are_typed_errors(spark):
    rng = random.Random(11)
    book = zipped(epub())
    rows = [(f"noise{k}.epub", rng.randbytes(rng.randint(1, 3000))) for k in range(40)]
    for k in range(40):  # a real book with some bytes changed or cut off
        b = bytearray(book)
        for _ in range(rng.randint(1, 40)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        rows.append((f"hurt{k}.epub", bytes(b[: rng.randint(4, len(b))])))
    deep = "<a>" * 3000 + "</a>" * 3000
    rows += [("deep.fb2", f"<FictionBook>{deep}</FictionBook>".encode()), ("odd.fb2", b"\xff\xfe<\0F\0x"), ("bad.fb2", b"\xef\xbb\xbf<FictionBook>\xff</FictionBook>"), ("empty.epub", b""), ("deep.epub", zipped(epub("<div>" * 3000 + "text")))]
    units = ebooks.units(spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary").repartition(3)).collect()
    by_path = {r.path: r for r in units}
    assert len(by_path) == len(rows) and all(r.error is None or r.error in policy.CODES for r in units)
    assert all(by_path[f"noise{k}.epub"].error for k in range(40))
    assert [by_path[p].error for p in ("deep.fb2", "odd.fb2", "bad.fb2", "empty.epub", "deep.epub")] == ["LIMIT_EXCEEDED", "INVALID_DOCUMENT", "INVALID_DOCUMENT", "INVALID_DOCUMENT", None]
    assert by_path["deep.epub"].markdown == "text"


def test_html_structure():
    markdown, warnings, refs = to_markdown("<h2>A</h2><p>b <b>c</b><ul><li>x<li>y</ul><pre>k  l</pre><p><a href='#n'>z</a>")
    assert markdown.startswith("## A") and "b **c**" in markdown and "- x\n- y" in markdown and "```\nk  l\n```" in markdown and "z (see note #n)" in markdown
    assert not warnings and not refs


@pytest.mark.parametrize("name", ["escape_inline", "harden_markdown", "entry_path_valid", "outline_sections", "instruction_scan", "manifest_order", "running_budget", "titled_paths"])
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "part", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    order = [got.columns.index(c) for c in sorted(got.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    theirs = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(str([r[i] for i in order]) for r in got.collect()) == sorted(str([r[i] for i in theirs]) for r in want.fetchall())


def test_case_fold_duplicates_compare_whole_texts(spark, tmp_path):
    start = "the same first words of each text, then"
    rows = [(1, start + " one", "a"), (2, start + " TWO", "a"), (3, start.upper() + " two", "a"), (4, start + " two", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in catalogue.queries()["case_fold_duplicates"](spark, str(tmp_path)).collect()] == [("a", start + " two", 2)]


def test_distinct_warnings_keep_the_policy_cap(spark, tmp_path):
    rows = [(k, 1, f"type{k % 5}") for k in range(20)] + [(100 + k, 2, f"type{k}") for k in range(policy.MAX_WARNINGS + 3)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in catalogue.queries()["distinct_warnings_cap"](spark, str(tmp_path)).collect()]
    want = [(1, f"type{k}") for k in range(5)] + [(2, f"type{k}") for k in range(policy.MAX_WARNINGS)]
    assert sorted(got) == sorted(want)


def test_text_functions_normalise_first(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "javascript:x<b>*")
    rows = spark.createDataFrame([(0, wide), (1, None), (2, "a" * 400 + "x"), (3, "a" * 400 + "y"), (4, "a" * 500 + "x"), (5, "a" * 500 + "y"), (6, "e\u0301\u00e9")], "k long, t string")
    c = rows.t
    out = rows.select("k", text.ESCAPE_INLINE.column(c), text.PLAIN.column(c), text.FB2_INLINE.column(c), text.heading_key(c)).orderBy("k").collect()
    assert tuple(out[0])[1:] == ("javascript:x&lt;b\\&gt;\\*", "javascript:x<b", "\\[unsafe URL removed\\]&lt;b\\&gt;\\*", "javascriptxb")
    assert tuple(out[1])[1:] == (None,) * 4 and tuple(out[6])[1:] == ("\u00e9\u00e9",) * 4
    keys = [r[4] for r in out]
    assert keys[2] != keys[3] and keys[4] == keys[5] == "a" * 500


def test_html_letters_reads_references_as_its_sql_does(spark, tmp_path):
    pages = ["<h1>fish and&amp</h1>", "<p>a &ampb &lt c &copy2 &nbsp;d &AMP; R&D &eacute;</p>", "<p>&amp;lt; &amp;amp; &lt;b&gt; &#39;x&quot;</p>", "<p>no reference</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalogue.queries()["html_letters"](spark, str(tmp_path)).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(catalogue.oracle_sql()["html_letters"]).fetchall())

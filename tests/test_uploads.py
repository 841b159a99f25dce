"""Text of uploaded files: PDF, docx and the legacy binary form, made here in small."""

from __future__ import annotations

import random
import struct
import zipfile
import zlib

import pytest

from pairloom.sources import io, office, portable


def pdf(content: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 >>", extra: bytes = b"", trailer: bytes = b"<< /Root 1 0 R >>", head: bytes = b"") -> bytes:
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /A 5 0 R >> /XObject << /X 6 0 R >> >> >>"
    return (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj " + page + b" endobj\n"
            b"4 0 obj << /Length " + str(len(content)).encode() + head + b" >> stream\n" + content + b"\nendstream endobj\n5 0 obj " + font + b" endobj\n" + extra + b"\ntrailer " + trailer)


@pytest.mark.parametrize("packed", [False, True])
def test_what_is_written_is_read(packed):
    r = random.Random(8)
    texts = ["", "\n\n", "(a\\b) <c> [d]", "Hồ sơ 😀\r\tx\x00\n", "\n".join(f"line {i}" for i in range(173))]
    for t in texts + ["".join(r.choices("ab(\\)<>\n é😀", k=r.randint(0, 900))) for _ in range(40)]:
        rows = t.split("\n")
        want = ["\n".join(rows[i : i + 50]) for i in range(0, len(rows), 50)]
        assert portable.pdf_pages(portable.to_pdf(t, 50, packed), 1000) == (want, len(want))
        assert portable.pdf_pages(portable.to_pdf(t, 50, packed), 2) == (want[:2], len(want))


def test_operators_strings_and_fonts_of_other_writers():
    read = lambda *a, **k: portable.pdf_pages(pdf(*a, **k))[0][0]
    assert read(rb"BT /A 9 Tf 1 0 0 1 40 700 Tm (one) Tj 1 0 0 1 90 700 Tm (two) Tj 1 0 0 1 40 690 Tm (three) Tj 0 -9 Td (four) Tj (five) ' ET") == "one two\nthree\nfour\nfive"
    assert read(rb"BT /A 9 Tf [(a) -50 (b) -400 (c\)\101\n) <6465>] TJ (x\
y) Tj ET % (comment) Tj") == "ab c)A\ndexy"
    assert read(b"BT /A 9 Tf (\x93q\x94 \xe9) Tj ET") == "“q” é"
    assert read(b"BT /A 9 Tf (a) Tj ET BI /W 1 ID \x00 (no) Tj \xff EI BT (b) Tj ET") == "ab"
    chart = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <41> <43> <0061> <50> <51> [<00660066> <1EA1>] endbfrange 1 beginbfchar <5A> <D83DDE00> endbfchar"
    extra = b"7 0 obj << /Length 0 >> stream\n" + chart + b"\nendstream endobj"
    assert read(b"BT /A 9 Tf (ABCPQZ?) Tj ET", font=b"<< /Type /Font /Subtype /Type1 /ToUnicode 7 0 R >>", extra=extra) == "abcffạ😀"
    form = b"6 0 obj << /Subtype /Form /Length 27 >> stream\nBT (in) Tj ET /X Do        \nendstream endobj"
    assert read(b"/X Do", extra=form).startswith("in")  # a form that draws itself ends at a fixed depth
    packed = zlib.compress(b"BT (deflated) Tj ET")
    assert read(packed, head=b" /Filter [/FlateDecode]") == "deflated"
    assert read(packed.hex().encode() + b">", head=b" /Filter [/ASCIIHexDecode /Fl]") == "deflated"
    assert read(packed, head=b" /Filter /DCTDecode") == "" and read(b"rubbish", head=b" /Filter /FlateDecode") == ""


def test_a_later_object_replaces_an_earlier_one():
    assert portable.pdf_pages(pdf(b"(old) Tj") + b"\n4 0 obj << /Length 8 >> stream\n(new) Tj\nendstream endobj")[0] == ["new"]


@pytest.mark.parametrize(
    ("data", "why"),
    [(b"", "invalid"), (b"%PDF-1.4", "invalid"), (b"text", "invalid"), (pdf(b"(x) Tj", trailer=b"<< /Root 1 0 R /Encrypt 9 0 R >>"), "encrypted"),
     (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R] >> endobj", "invalid"), (b"%PDF-1.4 1 0 obj " + b"[" * 5000, "invalid")],
)
def test_files_without_text_are_refused(data, why):
    with pytest.raises(portable.Refused, match=why):
        portable.pdf_pages(data)


def test_cut_files_never_raise_anything_else():
    r = random.Random(2)
    whole = portable.to_pdf("some text\nof lines", 1, True)
    for _ in range(300):
        broken = bytearray(whole[: r.randint(0, len(whole))])
        for _ in range(r.randint(0, 6)):
            if broken:
                broken[r.randrange(len(broken))] = r.randrange(256)
        try:
            portable.pdf_pages(bytes(broken))
        except portable.Refused:
            pass


def legacy(pieces: list[tuple[str, bool]], flags: int = office.SECOND_TABLE, large: bool = True) -> bytes:
    """A compound file with a main stream and a table of pieces (text, whether in single bytes)."""
    body, places, ends = bytearray(b"\0" * 1024), [], [0]
    for text, narrow in pieces:
        body += b"\0" * (len(body) % 2)
        places.append((len(body) * 2 | office.NARROW) if narrow else len(body))
        body += text.encode("cp1252" if narrow else "utf-16-le")
        ends.append(ends[-1] + len(text))
    table = struct.pack(f"<{len(ends)}I", *ends) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    chart = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(table)) + table
    struct.pack_into("<H", body, office.FLAGS_AT, flags)
    struct.pack_into("<I", body, office.LENGTH_AT, ends[-1])
    struct.pack_into("<II", body, office.PIECES_AT, 0, len(chart))
    least = 64 if large else 4096
    streams = {"WordDocument": bytes(body), "1Table" if flags & office.SECOND_TABLE else "0Table": chart}
    sectors, fat, few, pool, entries = [], [], [], b"", []

    def put(data: bytes) -> int:
        first, parts = len(sectors), [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        for i, p in enumerate(parts):
            sectors.append(p)
            fat.append(first + i + 1 if i + 1 < len(parts) else 0xFFFFFFFE)
        return first

    for name, data in streams.items():
        if len(data) >= least:
            start = put(data)
        else:
            start, n = len(pool) // 64, -(-len(data) // 64)
            pool += data.ljust(64 * n, b"\0")
            few += [start + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
        entries.append((name, 2, start, len(data)))
    entries.insert(0, ("Root Entry", 5, put(pool) if pool else 0xFFFFFFFE, len(pool)))
    listed = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, k) + b"\0" * 49 + struct.pack("<IIxxxx", s, z) for n, k, s, z in entries)
    directory = put(listed)
    short = put(struct.pack(f"<{len(few)}I", *few)) if few else 0xFFFFFFFE
    at = len(sectors)
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFD] + [0xFFFFFFFF] * 128)[:128]))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, directory, 0, least, short, 1 if few else 0, 0xFFFFFFFE, 0) + struct.pack("<109I", at, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


@pytest.mark.parametrize("flags", [0, office.SECOND_TABLE])
@pytest.mark.parametrize("large", [True, False])
def test_pieces_of_legacy_documents(flags, large):
    pieces = [("Kỹ sư\r", False), ("café “x”\r", True), ("a\x07b\x07\x07", True), ('see \x13 HYPERLINK "u" \x14here\x15 \x13 PAGE \x15end\r', False)]
    assert office.doc_text(legacy(pieces, flags, large)) == "Kỹ sư\ncafé “x”\na | b\nsee here end"


def test_legacy_documents_that_cannot_be_read():
    whole = legacy([("text\r", True)])
    with pytest.raises(portable.Refused, match="encrypted"):
        office.doc_text(legacy([("text\r", True)], office.ENCRYPTED))
    r = random.Random(5)
    for _ in range(200):
        broken = bytearray(whole[: r.randint(0, len(whole))])
        if len(broken) > 600:
            broken[r.randrange(len(broken))] = r.randrange(256)
        try:
            office.doc_text(bytes(broken))
        except portable.Refused:
            pass


def test_uploads_of_every_kind(spark, tmp_path):
    (tmp_path / "many.pdf").write_bytes(portable.to_pdf("\n".join("a line of thirty characters .." for _ in range(90)), 10))
    (tmp_path / "scan.pdf").write_bytes(portable.to_pdf("x\n" + "\n" * 8, 2))
    (tmp_path / "shut.pdf").write_bytes(pdf(b"(x) Tj", trailer=b"<< /Root 1 0 R /Encrypt 9 0 R >>"))
    (tmp_path / "old.doc").write_bytes(legacy([("old form\r", True)]))
    (tmp_path / "bad.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1"))
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "what.bin").write_bytes(b"\x01\x02")
    ns = f'xmlns:w="{office._W[1:-1]}"'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A &amp; B</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "new.docx", "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {ns}><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p>{table}</w:body></w:document>')
    got = {r.path.rsplit("/", 1)[1]: r for r in io.read_uploads(spark, str(tmp_path), max_pages=5).collect()}
    many = got["many.pdf"]
    assert (many.pages, many.warnings, many.error, many.text.count("\f"), many.text.count("line")) == (5, ["TRUNCATED"], None, 4, 50)
    assert (got["scan.pdf"].pages, got["scan.pdf"].warnings) == (5, ["OCR_LOW_QUALITY"])
    assert (got["shut.pdf"].text, got["shut.pdf"].error) == (None, "encrypted")
    assert got["old.doc"].text == "old form" and (got["bad.doc"].text, got["bad.doc"].error) == (None, "invalid")
    assert got["new.docx"].text == "one\ttwo\nA & B | c" and got["new.docx"].pages == 0
    assert "empty.txt" not in got and (got["what.bin"].kind, got["what.bin"].error) == (None, "invalid")


def test_null_and_empty_content(spark):
    rows = spark.createDataFrame([(1, None, "pdf"), (2, bytearray(b""), "text"), (3, bytearray(b"x"), None), (4, bytearray(b""), "docx")], "i int, content binary, kind string")
    got = {r.i: (r.x.text, r.x.pages, r.x.warnings, r.x.error) for r in rows.select("i", io.extracted(rows.content, rows.kind).alias("x")).collect()}
    assert got == {1: (None, 0, [], "invalid"), 2: ("", 0, [], None), 3: (None, 0, [], "invalid"), 4: (None, 0, [], "invalid")}
    assert rows.limit(0).select(io.extracted(rows.content, rows.kind)).count() == 0

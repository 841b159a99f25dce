"""Text of word-processing files: docx (XML in a zip) and the legacy binary form (a piece table in a compound file)."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

from pairloom.sources.portable import Refused

_MAIN, _W = "word/document.xml", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Fixed values of the legacy form: sector numbers that end a chain, and places in the head of the main stream.
END_OF_CHAIN, FLAGS_AT, LENGTH_AT, PIECES_AT = 0xFFFFFFFA, 0x0A, 0x4C, 0x01A2
ENCRYPTED, SECOND_TABLE, NARROW = 0x0100, 0x0200, 1 << 30


def holds_document(data: bytes | None) -> bool:
    try:
        return data is not None and _MAIN in zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile:
        return False


def docx_text(data: bytes) -> str:
    """Paragraphs by line; the cells of a table's row on one line, parted by bars."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(data)).read(_MAIN)
    except (zipfile.BadZipFile, KeyError) as broken:
        raise Refused("invalid") from broken
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:  # parts without a root or a declared prefix
        try:
            root = ElementTree.fromstring(f'<w:body xmlns:w="{_W[1:-1]}">{xml.decode("utf-8", "replace")}</w:body>')
        except ElementTree.ParseError as broken:
            raise Refused("invalid") from broken
    body = root if root.tag == f"{_W}body" else root.find(f"{_W}body")

    def said(paragraph: ElementTree.Element) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}  # a tab with attributes is a stop of the paragraph's format
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in paragraph.iter() if x.tag != f"{_W}tab" or not x.attrib)

    lines = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            lines.append(said(child))
        elif child.tag == f"{_W}tbl":
            lines += [" | ".join("\n".join(said(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) for row in child.findall(f"{_W}tr")]
    return "\n".join(lines).strip()


class Compound:
    """The streams of a compound file."""

    def __init__(self, data: bytes):
        self.data, self.size, self.small = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        directory, self.least, few, _, more, count = struct.unpack_from("<I4xIIIII", data, 48)
        tables = list(struct.unpack_from("<109I", data, 76))
        while more < END_OF_CHAIN and count > 0:
            *part, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables, count = tables + part, count - 1
        self.next = [x for t in tables if t < END_OF_CHAIN for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<II", entries, at + 116)
            if kind:
                self.entries[entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace") if kind != 5 else ""] = (start, size)
        self.few = struct.unpack(f"<{len(f) // 4}I", f) if (f := self._chain(few)) else ()
        self.pool = self._chain(self.entries[""][0]) if "" in self.entries else b""

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, i: int) -> bytes:
        """The sectors of a chain; one that runs in a circle is refused."""
        out: list[bytes] = []
        while i < END_OF_CHAIN:
            out.append(self._sector(i))
            i = self.next[i]
            if len(out) > len(self.next):
                raise Refused("invalid")
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name]
        if size >= self.least:
            return self._chain(start)[:size]
        out, i = [], start
        while i < END_OF_CHAIN and len(out) <= len(self.few):
            out.append(self.pool[i * self.small : (i + 1) * self.small])
            i = self.few[i]
        return b"".join(out)[:size]


def doc_text(data: bytes) -> str:
    """The main text by its pieces; instructions of fields are left out, their results stay, cells are parted by bars."""
    try:
        files = Compound(data)
        main = files.stream("WordDocument")
        flags, length = struct.unpack_from("<H", main, FLAGS_AT)[0], struct.unpack_from("<I", main, LENGTH_AT)[0]
        if flags & ENCRYPTED:
            raise Refused("encrypted")
        at, size = struct.unpack_from("<II", main, PIECES_AT)
        chart = files.stream("1Table" if flags & SECOND_TABLE else "0Table")[at : at + size]
        at = 0
        while chart[at] == 1:  # properties stand before the table
            at += 3 + struct.unpack_from("<H", chart, at + 1)[0]
        pieces = (struct.unpack_from("<I", chart, at + 1)[0] - 4) // 12
        ends = struct.unpack_from(f"<{pieces + 1}I", chart, at + 5)
        out = []
        for i in range(pieces):
            place = struct.unpack_from("<I", chart, at + 5 + 4 * (pieces + 1) + 8 * i + 2)[0]
            n = max(0, min(ends[i + 1], length) - ends[i])
            start = (place & (NARROW - 1)) // (2 if place & NARROW else 1)
            out.append(main[start : start + n].decode("cp1252", "replace") if place & NARROW else main[start : start + 2 * n].decode("utf-16-le", "replace"))
    except (struct.error, IndexError, KeyError, MemoryError, OverflowError) as broken:
        raise Refused("invalid") from broken
    text, before = "".join(out), None
    while text != before:  # fields may stand within fields, the innermost go first
        before, text = text, re.sub("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15", lambda m: m[1] or "", text)
    text = re.sub("\x07{2,}", "\n", text).replace("\x07", " | ")
    return re.sub("[\x00-\x08\x0e-\x1f]", "", text.replace("\r", "\n").replace("\x0b", "\n")).strip()

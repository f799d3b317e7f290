"""Text of office files and PDFs, as Markdown, from their bytes.

Word and Excel files are zip archives of XML; both are read with the standard library, within caps on
what an archive may unfold to. PDFs need ``pypdf``; without it they have no text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that an archive's member, and all of them, may unfold to; bytes of a PDF.
MEMBER_BYTES, ARCHIVE_BYTES, PDF_BYTES = 64 << 20, 256 << 20, 64 << 20
# Namespaces of the two formats.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _members(data: bytes) -> dict[str, bytes]:
    """The XML members of an archive; none if it is over a cap or declares entities."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) > ARCHIVE_BYTES or any(i.file_size > MEMBER_BYTES for i in infos):
            return {}
        found = {i.filename: z.read(i) for i in infos if i.filename.endswith((".xml", ".rels"))}
    return {} if any(b"<!DOCTYPE" in x[:4096] or b"<!ENTITY" in x[:4096] for x in found.values()) else found


def _table(rows: list[list[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])] if rows else []


def docx_text(data: bytes) -> str:
    """Paragraphs with headings and list marks, then tables."""
    root = ElementTree.fromstring(_members(data)["word/document.xml"])
    body = root.find(f"{_WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    lines, tables = [], []
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}tbl":
            tables += _table([[said(c) for c in row.findall(f"{_WORD}tc")] for row in e.findall(f"{_WORD}tr")])
        elif e.tag == f"{_WORD}p":
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = re.sub(r"\s", "", style.get(f"{_WORD}val", "")) if style is not None else ""
            level = re.match(r"Heading([123])", name)
            mark = "#" * int(level[1]) + " " if level else "- " if name.startswith("List") else ""
            text = said(e)
            lines.append(mark + text if text else "")
    return "\n".join(lines + tables)


def xlsx_text(data: bytes) -> str:
    """Each sheet under its name as a table; rows without a value are left out."""
    parts = _members(data)
    shared = []
    if "xl/sharedStrings.xml" in parts:
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(parts["xl/sharedStrings.xml"]).findall(f"{_SHEET}si")]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(parts.get("xl/_rels/workbook.xml.rels", b"<r/>"))}
    out = []
    for sheet in ElementTree.fromstring(parts["xl/workbook.xml"]).iter(f"{_SHEET}sheet"):
        at = targets.get(sheet.get(_RELATION), "").lstrip("/")
        xml = parts.get(at if at.startswith("xl/") else f"xl/{at}")
        rows = []
        for row in ElementTree.fromstring(xml).iter(f"{_SHEET}row") if xml else ():
            cells = []
            for c in row.findall(f"{_SHEET}c"):
                column = 0
                for ch in re.match("[A-Z]*", c.get("r", "")).group():
                    column = 26 * column + ord(ch) - 64
                cells += [""] * (column - 1 - len(cells))
                v = c.findtext(f"{_SHEET}v") or ""
                if c.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                elif c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                cells.append(v)
            if any(cells):
                rows.append(cells)
        if rows:
            out += [f"## Sheet: {sheet.get('name', '')}", *_table(rows)]
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    if len(data) > PDF_BYTES:
        return ""
    return "\n".join(t for p in PdfReader(io.BytesIO(data)).pages if (t := p.extract_text()))


_READERS = {"docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


def file_text(path: str, data: bytes | None) -> str:
    """Markdown of one file; empty if it cannot be read."""
    read = _READERS.get(path.rpartition(".")[2].lower())
    try:
        return read(data) if read and data else ""
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, OSError, RuntimeError):
        return ""


def office_texts(files: DataFrame) -> DataFrame:
    """(path, text) of office files and PDFs among (path, content), content being bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [file_text(p, None if d is None else bytes(d)) for p, d in zip(b["path"], b["content"], strict=True)]})

    wanted = files.where(F.lower("path").rlike(r"\.(docx|xlsx|pdf)$")).select("path", "content")
    return wanted.mapInPandas(run, "path string, text string")

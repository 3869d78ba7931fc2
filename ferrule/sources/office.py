"""Office files, which are archives of XML: documents and sheets, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

MAX_UNPACKED = 100 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _opened(raw: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ValueError("not an office file") from e
    if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
        raise ValueError("the file unpacks to too much")
    return z


def _part(z: zipfile.ZipFile, name: str) -> ET.Element:
    try:
        raw = z.read(name)
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise ValueError("entities are not allowed")
        return ET.fromstring(raw)
    except (KeyError, ET.ParseError) as e:
        raise ValueError(f"{name} is missing or broken") from e


def _text(node: ET.Element) -> str:
    return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))


def docx_segments(raw: bytes, section: str, table) -> list[tuple[str, str, str]]:
    """``(section, text, kind)`` of a document: a heading starts a section, a table is a segment of its own."""
    body = _part(_opened(raw), "word/document.xml").find(f"{_W}body")
    out: list[tuple[str, str, str]] = []
    lines: list[str] = []

    def flush() -> None:
        if "\n".join(lines).strip():
            out.append((section, "\n".join(lines).strip(), "text"))
        lines.clear()

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            s = _text(node).strip()
            if style is not None and re.match(r"(?i)(heading|标题|title|[1-6]$)", style.get(f"{_W}val", "")) and s:
                flush()
                section = s
            elif s:
                lines.append(s)
        elif node.tag == f"{_W}tbl":
            flush()
            rows = [[_text(cell).strip() for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            if rows:
                out.append((section, table(rows), "table"))
    flush()
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_segments(raw: bytes, table, most: int) -> list[tuple[str, str, str]]:
    """``(sheet, rows as a table, kind)`` of every sheet with a filled row; blank rows are left out."""
    z = _opened(raw)
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _part(z, "xl/sharedStrings.xml")]
    target = {r.get("Id"): r.get("Target", "") for r in _part(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _part(z, "xl/workbook.xml").iter(f"{_S}sheet"):
        path = target.get(sheet.get(f"{_R}id"), "").lstrip("/")
        rows = []
        for row in _part(z, path if path.startswith("xl/") else f"xl/{path}").iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall(f"{_S}c")):
                v = c.find(f"{_S}v")
                s = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells[_column(c.get("r", "")) if c.get("r") else k] = shared[int(s)] if c.get("t") == "s" and s else s
            if any(x.strip() for x in cells.values()):
                rows.append([cells.get(k, "") for k in range(max(cells) + 1)])
            if len(rows) > most:
                break
        if rows:
            out.append((sheet.get("name", ""), table(rows), "table"))
    return out

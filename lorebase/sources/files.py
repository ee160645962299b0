"""Files as documents: a distributed scan of whole files, decoded and parsed by suffix in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basic_clean
from ..session import ship

# Suffixes by kind, and the encodings that are tried in this order after the preferred one.
KINDS = {"text": (".txt", ".md", ".markdown"), "docx": (".docx",), "pdf": (".pdf",), "csv": (".csv",), "excel": (".xlsx", ".xls"), "image": (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".webp")}
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(data: bytes, preferred: str | None = None) -> str:
    for name in (preferred, *ENCODINGS):
        if name:
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
    return data.decode("latin-1")


def parse_docx(data: bytes) -> str:
    """Paragraphs that aren't blank, parted by blank lines, then tables row by row with cells joined by ` | `."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts = [text(p) for p in body.findall(f"{_W}p")]
    rows = [" | ".join(text(c).strip() for c in row.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for row in t.findall(f"{_W}tr")]
    return "\n\n".join(x for x in [*parts, "\n".join(rows)] if x.strip())


def parse_xlsx(data: bytes) -> str:
    """The first sheet as a table of text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    return sheet_text(z, "xl/worksheets/sheet1.xml", shared_strings(z))


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]


def sheet_text(z: zipfile.ZipFile, member: str, shared: list[str]) -> str:
    """A sheet of a workbook as a table of text, its first row the head; empty without rows."""
    rows = []
    for row in ElementTree.fromstring(z.read(member)).iter(f"{_S}row"):
        cells = {}
        for c in row.findall(f"{_S}c"):
            v = c.find(f"{_S}v")
            value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if v is None else v.text or ""
            column = 0
            for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                column = column * 26 + ord(letter) - 64
            cells[column or len(cells) + 1] = shared[int(value)] if c.get("t") == "s" else value
        rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return pd.DataFrame(rows[1:], columns=rows[0]).to_string(index=False)



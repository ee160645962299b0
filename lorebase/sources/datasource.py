"""`spark.read.format("documents")`: files as rows of pages, sheets and blocks, by batch or as a stream of a folder."""

from __future__ import annotations

import codecs
import importlib
import operator
import re
import time
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from ..session import ship
from .files import _S, _W, ENCODINGS, KINDS, shared_strings, sheet_text

SCHEMA = "path string, suffix string, size long, unit string, number int, name string, text string, error string"
SUFFIXES = frozenset(s for group in KINDS.values() for s in group)
_COMPARED = {ds.EqualTo: operator.eq, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass(frozen=True)
class Found:
    path: str
    suffix: str
    size: int
    modified: int  # nanoseconds


@dataclass
class Bin(ds.InputPartition):
    """Files that one task reads."""

    files: list[Found]


def files_below(path: str, recursive: bool) -> list[Found]:
    """The readable files, by path. A file's own path may be given; names that begin with `.` or `_` are left out."""
    system, root = fs.FileSystem.from_uri(path)
    at = system.get_file_info(root)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=recursive))
    out = []
    for i in infos:
        below = i.path[len(root) :] if i.path != root else f"/{i.base_name}"
        suffix = f".{i.extension.lower()}"
        if i.type == fs.FileType.File and suffix in SUFFIXES and not re.search(r"(^|/)[._]", below):
            out.append(Found(i.path, suffix, i.size, i.mtime_ns))
    return sorted(out, key=lambda f: f.path)


def bins(files: Iterable[Found], most_bytes: int) -> list[Bin]:
    """Files in order, parted so that a part has most_bytes at most or one file; a file costs 4 KB at least, as opening does."""
    out, filled = [], 0
    for f in files:
        cost = max(f.size, 4096)
        if not out or filled + cost > most_bytes:
            out.append(Bin([]))
            filled = 0
        out[-1].files.append(f)
        filled += cost
    return out


def text_blocks(open_file, block: int, preferred: str | None = None) -> Iterator[str]:
    """The decoded text in pieces of about `block` characters that end with a line where one does; joined they are the text.

    The first encoding that fits the whole file is taken, found by a pass of its own, so no file is held whole.
    """
    for name in (preferred, *ENCODINGS):
        if name:
            decoder = codecs.getincrementaldecoder(name)()
            try:
                with open_file() as f:
                    while data := f.read(block):
                        decoder.decode(data)
                decoder.decode(b"", True)
                break
            except UnicodeDecodeError:
                continue
    decoder, rest = codecs.getincrementaldecoder(name)(), ""
    with open_file() as f:
        while data := f.read(block):
            rest += decoder.decode(data)
            if len(rest) >= block:
                end = rest.rfind("\n") + 1 or len(rest)
                yield rest[:end]
                rest = rest[end:]
    rest += decoder.decode(b"", True)
    if rest:
        yield rest


def _docx(z: zipfile.ZipFile) -> Iterator[tuple[str, str | None, str]]:
    """Paragraphs, then tables, that aren't blank."""
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    say = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    yield from (("paragraph", None, say(p)) for p in body.findall(f"{_W}p") if say(p).strip())
    for t in body.findall(f"{_W}tbl"):
        rows = "\n".join(" | ".join(say(c).strip() for c in row.findall(f"{_W}tc")) for row in t.findall(f"{_W}tr"))
        if rows.strip():
            yield "table", None, rows


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, str | None, str]]:
    """Every sheet in the order of the workbook, under its name."""
    shared = shared_strings(z)
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = links[sheet.get(_REL)]
        yield "sheet", sheet.get("name"), sheet_text(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared)


def units(f: Found, system: fs.FileSystem, options: dict[str, str]) -> Iterator[tuple[str, str | None, str]]:
    """(unit, name, text) of a file: pages of pdf, sheets of xlsx, paragraphs and tables of docx, rows of csv, blocks of text."""
    kind = next(k for k, group in KINDS.items() if f.suffix in group)
    if kind == "text":
        yield from (("block", None, t) for t in text_blocks(lambda: system.open_input_file(f.path), int(options.get("blockbytes", 1 << 20)), options.get("encoding")))
        return
    with system.open_input_file(f.path) as data:
        if kind == "docx":
            yield from _docx(zipfile.ZipFile(data))
        elif f.suffix == ".xlsx":
            yield from _xlsx(zipfile.ZipFile(data))
        elif kind == "csv":
            for rows in pd.read_csv(data, encoding=options.get("encoding", "utf-8"), chunksize=int(options.get("blockrows", 10_000))):
                yield "rows", None, rows.to_string(index=False)
        elif kind == "pdf":
            import pypdf

            for page in pypdf.PdfReader(data).pages:
                yield "page", None, page.extract_text() or ""
        elif kind == "image" and "ocr" in options:
            module, _, function = options["ocr"].partition(":")
            yield "image", None, getattr(importlib.import_module(module), function)(data.read())
        else:
            raise ValueError("no OCR function is given" if kind == "image" else f"unsupported suffix {f.suffix}")


class _Source:
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        if "path" not in self.options:
            raise ValueError("documents: a path is needed")
        self.path = self.options["path"]
        self.recursive = self.options.get("recursive", "false").lower() == "true"
        self.most_bytes = int(self.options.get("partitionbytes", 128 << 20))

    def read(self, partition: Bin) -> Iterator[tuple]:
        """A row for each unit, numbered from 1; a file that fails ends with a row that tells the error and has no text."""
        system, _ = fs.FileSystem.from_uri(self.path)
        for f in partition.files:
            number = 0
            try:
                for unit, name, text in units(f, system, self.options):
                    number += 1
                    yield f.path, f.suffix, f.size, unit, number, name, text, None
            except Exception as e:  # told in the row
                yield f.path, f.suffix, f.size, None, number + 1, None, None, f"{type(e).__name__}: {e}"


class Reader(_Source, ds.DataSourceReader):
    """Filters on path, suffix and size choose files before any is opened; Spark applies all others."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.chosen: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) != 1 or column[0] not in ("path", "suffix", "size"):
                yield f
            elif isinstance(f, ds.In):
                self.chosen.append((column[0], lambda x, among: x in among, frozenset(f.value)))
            elif type(f) in _COMPARED and f.value is not None:
                self.chosen.append((column[0], _COMPARED[type(f)], f.value))
            elif not isinstance(f, ds.IsNotNull):  # these three are never null
                yield f

    def partitions(self) -> list[Bin]:
        files = (f for f in files_below(self.path, self.recursive) if all(holds(getattr(f, c), v) for c, holds, v in self.chosen))
        return bins(files, self.most_bytes) or [Bin([])]


class Stream(_Source, ds.DataSourceStreamReader):
    """Files by the time of their last change. A batch takes those changed since the last one, up to `settle` seconds ago
    (2), so that files with equal times come together. A file that is changed again comes again, whole."""

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        return {"modified": time.time_ns() - int(float(self.options.get("settle", "2")) * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Bin]:
        return bins((f for f in files_below(self.path, self.recursive) if start["modified"] < f.modified <= end["modified"]), self.most_bytes)


class Documents(ds.DataSource):
    """Options: path (any that pyarrow's file systems read), recursive, partitionBytes (128 MB), blockBytes (1 MB), blockRows
    (10,000), encoding, ocr (`module:function` of an image's bytes, found on the workers), and for streams settle."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> Stream:
        return Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)

"""Data sources for containers that no reader of Spark's splits: tar archives of market streams, and workbooks.

    spark.dataSource.register(archives.TarLines)
    spark.read.format("tar_lines").option("event_type", "1").option("market_types", "MATCH_ODDS").load("/data/2024.tar")

A tar archive is cut at members into ranges of about `partition_bytes`, found by its headers alone; each
range is read member by member, so neither an archive nor a range is ever one row, and a
member whose first definition is of another sport or market is left before its lines are made. A
workbook is read row by row out of its zip. Paths are files, folders of them or URIs that Arrow can open.
"""

import bz2
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 512
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Number formats of workbooks that are dates or times; fixed values.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def files_of(path: str, *suffixes: str) -> list[tuple[fs.FileSystem, str]]:
    """The files of a path, a folder or a comma-separated list of them, in order; none if there is nothing."""
    out = []
    for one in path.split(","):
        system, place = fs.FileSystem.from_uri(one) if "://" in one else (fs.LocalFileSystem(), one)
        info = system.get_file_info(place)
        if info.type == fs.FileType.Directory:
            out += [(system, f.path) for f in sorted(system.get_file_info(fs.FileSelector(place, recursive=True)), key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(suffixes)]
        elif info.type == fs.FileType.File:
            out.append((system, place))
    return out


def opened(path: str):
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def header_at(file, offset: int) -> tuple[str, str, int] | None:
    """(name, kind, size) of the member whose header stands at an offset; None at the archive's end or where nothing can be read."""
    file.seek(offset)
    raw = file.read(BLOCK)
    if len(raw) < BLOCK or not raw.strip(b"\0"):
        return None
    text = lambda a, b: raw[a:b].split(b"\0", 1)[0].decode("utf-8", "replace")
    try:
        size = int.from_bytes(raw[125:136], "big") if raw[124] & 0x80 else int(text(124, 136).strip() or "0", 8)
    except ValueError:
        return None
    prefix = text(345, 500) if raw[257:262] == b"ustar" else ""
    return (f"{prefix}/{text(0, 100)}" if prefix else text(0, 100)), chr(raw[156] or 48), size


def members(file, offset: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, offset of the data, size) of the files whose headers stand from offset up to end; long names are read from the entries before them."""
    long_name = None
    while offset < end and (found := header_at(file, offset)):
        name, kind, size = found
        data = offset + BLOCK
        if kind in "Lx":
            file.seek(data)
            body = file.read(size)
            if kind == "L":
                long_name = body.rstrip(b"\0").decode("utf-8", "replace")
            elif m := re.search(rb"\d+ path=([^\n]*)\n", body):
                long_name = m[1].decode("utf-8", "replace")
        else:
            if kind == "0":
                yield long_name or name, data, size
            long_name = None
        offset = data + -(-size // BLOCK) * BLOCK


def cuts(file, least: int) -> list[int]:
    """Offsets of members, the first and then one at least so many bytes after the last, and the end; an entry with a long name stays with its member."""
    out, offset, joined = [0], 0, False
    while found := header_at(file, offset):
        if not joined and offset - out[-1] >= least:
            out.append(offset)
        joined = found[1] in "Lx"
        offset += BLOCK + -(-found[2] // BLOCK) * BLOCK
    return [*out, offset] if offset > out[-1] else out


def definition(text: str) -> dict:
    """The first market definition of a stream's lines, {} if there is none; only the lines up to it are parsed."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        line, at = (text[at:], len(text)) if end < 0 else (text[at:end], end + 1)
        if '"marketDefinition"' in line:
            try:
                changes = json.loads(line).get("mc") or []
            except (ValueError, AttributeError):
                continue
            for c in changes:
                if isinstance(c, dict) and isinstance(c.get("marketDefinition"), dict):
                    return c["marketDefinition"]
    return {}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class TarLines(DataSource):
    """(file, seq, value): the lines of each member. Options: event_type, market_types (comma-separated), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return "file string, seq int, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.event_type = options.get("event_type")
        self.market_types = frozenset(x for x in (options.get("market_types") or "").split(",") if x)
        self.least = int(options.get("partition_bytes") or 64 << 20)

    def partitions(self) -> list[Range]:
        out = []
        for system, place in files_of(self.path, ".tar"):
            with system.open_input_file(place) as file:
                at = cuts(file, self.least)
            out += [Range(place if "://" not in self.path else f"{system.type_name}://{place}", a, b) for a, b in zip(at, at[1:], strict=False)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        with opened(partition.path) as file:
            for name, data, size in members(file, partition.start, partition.end):
                file.seek(data)
                raw = file.read(size)
                try:
                    text = (bz2.decompress(raw) if name.endswith(".bz2") else raw).decode("utf-8", "replace")
                except (OSError, ValueError, EOFError):
                    continue  # a broken member is left out, its neighbours are not
                if self.event_type or self.market_types:
                    d = definition(text)
                    if self.event_type and d.get("eventTypeId") != self.event_type or self.market_types and d.get("marketType") not in self.market_types:
                        continue
                for seq, line in enumerate(text.splitlines()):
                    if line.strip():
                        yield f"{partition.path}#{name}", seq, line


class Workbook(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WorkbookRows(DataSource):
    """Rows of workbooks under the names of their header row, as text; a schema names the columns that are wanted, in any order.

    Without one, (file, sheet, row, cells): every row as it stands. Options: sheet (a name; all by default), header (the header's row number, 1).
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options, schema.names)


class WorkbookReader(DataSourceReader):
    def __init__(self, options, names: list[str]) -> None:
        self.path, self.sheet, self.header = options["path"], options.get("sheet"), int(options.get("header") or 1)
        self.names = None if names == ["file", "sheet", "row", "cells"] else names

    def partitions(self) -> list[Workbook]:
        return [Workbook(place if "://" not in self.path else f"{system.type_name}://{place}") for system, place in files_of(self.path, ".xlsx")] or [Workbook("")]

    def read(self, partition: Workbook) -> Iterator[tuple]:
        if not partition.path:
            return
        with opened(partition.path) as file, zipfile.ZipFile(file) as book:
            for sheet, rows in sheets(book, self.sheet):
                at = None
                for number, cells in rows:
                    if self.names is None:
                        yield partition.path, sheet, number, cells
                    elif at is None:
                        if number >= self.header:
                            titles = [(c or "").strip() for c in cells]
                            at = [titles.index(n) if n in titles else -1 for n in self.names]
                    elif any(c not in (None, "") for c in cells):
                        yield tuple(cells[i] if 0 <= i < len(cells) else None for i in at)


def sheets(book: zipfile.ZipFile, wanted: str | None) -> Iterator[tuple[str, Iterator[tuple[int, list]]]]:
    """(name, rows) of a workbook's sheets in order."""
    parts = set(book.namelist())
    xml = lambda part: ElementTree.fromstring(book.read(part))
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in xml("xl/sharedStrings.xml").iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in parts else []
    dates = date_styles(xml("xl/styles.xml")) if "xl/styles.xml" in parts else set()
    for s in xml("xl/workbook.xml").iter(f"{SHEET}sheet"):
        target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
        if wanted in (None, s.get("name")):
            yield s.get("name"), sheet_rows(book, posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), shared, dates)


def date_styles(styles: ElementTree.Element) -> set[str]:
    """The numbers of the cell styles that show dates."""
    own = {f.get("numFmtId") for f in styles.iter(f"{SHEET}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or ""), re.I)}
    cells = styles.find(f"{SHEET}cellXfs")
    return {str(i) for i, x in enumerate(cells if cells is not None else []) if x.get("numFmtId") in own or int(x.get("numFmtId") or 0) in DATE_FORMATS}


def sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[str]) -> Iterator[tuple[int, list]]:
    """(number, cells as text) of each row; a row's elements are dropped once it is read."""
    with book.open(part) as file:
        number = 0
        for _, e in ElementTree.iterparse(file):
            if e.tag != f"{SHEET}row":
                continue
            number, cells = int(e.get("r") or number + 1), []
            for c in e.iter(f"{SHEET}c"):
                if letters := re.match(r"[A-Z]+", c.get("r") or ""):
                    column = 0
                    for x in letters[0]:
                        column = 26 * column + ord(x) - 64
                    cells += [None] * (column - 1 - len(cells))
                cells.append(cell_text(c, shared, dates))
            yield number, cells
            e.clear()


def cell_text(c: ElementTree.Element, shared: list[str], dates: set[str]) -> str | None:
    kind, value = c.get("t"), c.findtext(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind is None and c.get("s") in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(value))
        return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(sep=" ", timespec="seconds")
    return value

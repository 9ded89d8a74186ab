"""Workbooks and word-processor files, read from and written to their zipped XML with the standard library alone.

A file is one unit of work, as its parts only make sense together; folders of files are read in parallel. A file that
cannot be read gives one row with its error, and no other file suffers. Blank rows and paragraphs are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import near, shipped

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = 1_048_576
#: bytes that a zipped part may have when unpacked; a part beyond that is an error of its file
MOST = 1 << 28
#: of the widest sheet
COLUMNS = 16_384


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST:
        raise ValueError(f"{name} is too large")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096]:  # no entities: they could grow without bound
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
        if n > COLUMNS:
            raise ValueError(f"{reference} is beyond the last column")
    return n - 1


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of each row with a value, in order; numbers without a needless .0, booleans as true or false."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in _part(archive, "xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in _part(archive, "xl/_rels/workbook.xml.rels")}
        for sheet in _part(archive, "xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = targets[sheet.get(LINK)]
            for at, row in enumerate(_part(archive, target if target.startswith("xl/") else f"xl/{target}").iter(f"{MAIN}row"), 1):
                cells: list[str] = []
                for cell in row.iter(f"{MAIN}c"):
                    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v") or ""
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind is None and re.fullmatch(r"-?[0-9]+\.0+", value):
                        value = value.split(".")[0]
                    place = _column(cell.get("r") or "") if cell.get("r") else len(cells)
                    cells += [""] * (place + 1 - len(cells))
                    cells[place] = value
                if any(c.strip() for c in cells):
                    yield sheet.get("name") or "", int(row.get("r") or at), cells


def document_paragraphs(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(number, style, text) of each paragraph with text; headings of level n have the style Hn, others none."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in _part(archive, "word/styles.xml").iter(f"{WORD}style"):
                shown = style.find(f"{WORD}name")
                names[style.get(f"{WORD}styleId")] = shown.get(f"{WORD}val") if shown is not None else ""
        for at, p in enumerate(_part(archive, "word/document.xml").iter(f"{WORD}p")):
            text = "".join({f"{WORD}t": n.text or "", f"{WORD}tab": "\t", f"{WORD}br": "\n"}.get(n.tag, "") for n in p.iter())
            style = p.find(f"{WORD}pPr/{WORD}pStyle")
            own = style.get(f"{WORD}val") if style is not None else ""
            level = re.search(r"(?i)heading *([1-9])$", names.get(own) or own or "")
            if text.strip():
                yield at, f"H{level[1]}" if level else "", text


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    shipped(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells, error of all workbooks below a folder."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [(name, *row, "") for row in workbook_rows(bytes(data))]
                except Exception as e:  # noqa: BLE001 - any damage of a file is that file's error
                    rows = [(name, "", 0, [], f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"])

    return _files(spark, path, "*.xls[xm]").mapInPandas(read, "path string, sheet string, row int, cells array<string>, error string")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file, at, style, text, error of all word-processor files below a folder; see audits.from_headings()."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [(name, *row, "") for row in document_paragraphs(bytes(data))]
                except Exception as e:  # noqa: BLE001
                    rows = [(name, 0, "", "", f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["file", "at", "style", "text", "error"])

    return _files(spark, path, "*.docx").mapInPandas(read, "file string, at int, style string, text string, error string")


def headed(rows: DataFrame, known: list[str], first: int = 20) -> DataFrame:
    """Workbook rows as path, sheet, row and `fields`, a map from header to cell.

    A sheet's header is the first of its rows up to number `first` that has a known name, whatever its case and spaces;
    rows above it and sheets without one are left out. Of equal headers the first counts.
    """
    fold = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    names = F.array(*(fold(F.lit(k)) for k in known))
    heads = rows.where((F.col("error") == "") & (F.col("row") <= first) & F.exists("cells", lambda c: F.array_contains(names, fold(c))))
    heads = heads.groupBy("path", "sheet").agg(F.min(F.struct("row", "cells")).alias("h")).select("path", "sheet", F.col("h.row").alias("top"), F.col("h.cells").alias("head"))
    body = rows.join(near(heads), ["path", "sheet"]).where("row > top")
    pairs = F.filter(F.transform("head", lambda h, i: F.struct(F.trim(h).alias("k"), F.get("cells", i).alias("v"))), lambda p: (p["k"] != "") & p["v"].isNotNull())
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return body.select("path", "sheet", "row", F.map_from_entries(once).alias("fields"))


def workbook_bytes(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook of tables of text, one sheet each, with a header; a sheet is bounded by what the format holds, and by that
    what comes to the driver. Nested columns must be flat before; see writers.sheets()."""
    out = io.BytesIO()
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        relation = lambda i, what, target: f'<Relationship Id="r{i}" Type="{kind}/{what}" Target="{target}"/>'
        around = lambda body: f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'
        archive.writestr("_rels/.rels", around(relation(1, "officeDocument", "xl/workbook.xml")))
        archive.writestr("xl/_rels/workbook.xml.rels", around("".join(relation(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1))))
        listed = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{kind}"><sheets>{listed}</sheets></workbook>')
        cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        for i, rows in enumerate(sheets.values(), 1):
            found = rows.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).limit(ROWS).collect()
            if len(found) >= ROWS:
                raise ValueError(f"a sheet holds {ROWS - 1} rows at most")
            lines = [tuple(rows.columns), *map(tuple, found)]
            body = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in lines)
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()

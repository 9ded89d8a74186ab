"""Import of a folder of mixed files as one job: each file's shape is told by its content, not by its name, and each becomes
records; a file that cannot be read is a record with an error.

Shapes: workbook and document (zipped XML), json (an array of objects, or an object that holds one under `questions` or
`data`, or one with chapters), lines (such an object on each line), text (UTF-8, else a fallback encoding); pdf and database files
are told but not read here (see readers.register_pages and the table reader), and are errors. A file is read by one task,
but large ones of lines in splits; files are spread over tasks. Empty files have no records; unreadable ones do.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import kept, shipped
from .office import document_paragraphs, workbook_rows

RECORD = "path string, shape string, part string, at int, record string, error string"
LISTS = ("questions", "data")
#: bytes up to which a file is read as a whole whatever its shape
WHOLE = 4_000_000


def _objects(value) -> Iterator[tuple[str, dict]]:
    """(part, object) of a JSON value; anything else is an error of its file."""
    if isinstance(value, dict):
        held = next((value[k] for k in LISTS if isinstance(value.get(k), list)), None)
        if held is None:
            yield "", value
            return
        value, part = held, str(value.get("chapter") or "")
    elif isinstance(value, list):
        part = ""
    else:
        raise ValueError("neither a list nor an object")
    for x in value:
        if not isinstance(x, dict):
            raise ValueError("an item is no object")
        if isinstance(x.get("questions"), list):
            yield from _objects(x)
        else:
            yield part, x


def _text(data: bytes, fallback: str) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode(fallback)


def shape_of(data: bytes) -> str:
    """A file's shape by its first bytes, and for zipped ones by the names inside."""
    head = data[:512].removeprefix(b"\xef\xbb\xbf").lstrip()
    if data.startswith(b"PK\x03\x04"):
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        return "workbook" if "xl/workbook.xml" in names else "document" if "word/document.xml" in names else "archive"
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(b"SQLite format 3\x00"):
        return "database"
    if head[:1] in (b"[", b"{"):
        try:
            json.loads(_text(data, "utf-8"))
            return "json"
        except ValueError:
            try:  # a first line that is whole makes it lines
                return "lines" if isinstance(json.loads(_text(data, "utf-8").lstrip().split("\n", 1)[0]), dict) else "json"
            except ValueError:
                return "json"
    return "text"


def _records(shape: str, data: bytes, fallback: str) -> Iterator[tuple[str, int, str, str]]:
    """(part, at, record as JSON, error)."""
    write = lambda x: json.dumps(x, ensure_ascii=False)
    if shape == "workbook":
        heads: dict[str, list[str]] = {}
        for sheet, row, cells in workbook_rows(data):
            if sheet not in heads:
                heads[sheet] = [c.strip() for c in cells]
                continue
            yield sheet, row, write({h: c for h, c in reversed(list(zip(heads[sheet], cells, strict=False))) if h}), ""
    elif shape == "document":
        for at, style, text in document_paragraphs(data):
            yield style, at, write({"text": text, "style": style}), ""
    elif shape == "json":
        for at, (part, x) in enumerate(_objects(json.loads(_text(data, fallback)))):
            yield part, at, write(x), ""
    elif shape == "lines":
        for at, line in enumerate(_text(data, fallback).split("\n")):
            yield from _line_records(line.encode("utf-8", "surrogatepass"), at, fallback)
    elif shape == "text":
        text = _text(data, fallback)
        if text.strip():
            yield "", 0, write({"text": text}), ""
    else:
        raise ValueError(f"{shape} files are not read here")


def _line_records(line: bytes, at: int, fallback: str) -> Iterator[tuple[str, int, str, str]]:
    text = _text(line, fallback)
    if text.strip():
        try:
            for part, x in [*_objects(json.loads(text))]:
                yield part, at, json.dumps(x, ensure_ascii=False), ""
        except ValueError as e:
            yield "", at, "", f"line {at + 1}: {e}"[:200]


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each file and block of it: its lines, those with text, whether all are UTF-8, and whether the first with text is an object."""
    told: dict[tuple[str, int], list] = {}
    for part in parts:
        for file, block, line in zip(part["file"], part["block"], part["value"], strict=True):
            x = told.setdefault((file, block), [0, 0, True, False])
            x[0] += 1
            try:
                text = bytes(line).decode("utf-8-sig")
            except UnicodeDecodeError:
                x[2] = False
                continue
            if text.strip():
                x[1] += 1
                if x[1] == 1:
                    try:
                        x[3] = isinstance(json.loads(text), dict)
                    except ValueError:
                        pass
    yield pd.DataFrame([(*k, *x) for k, x in told.items()], columns=["file", "block", "n", "filled", "valid", "object"])


def large_lines(spark: SparkSession, path: str, fallback: str) -> tuple[DataFrame | None, list[str]]:
    """RECORD rows of the files below a folder that are larger than WHOLE and of the shape `lines`, and these files: they
    are read by Spark in splits, a batch of lines at a time. Lines are numbered in their file all the same."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") > WHOLE).select("path", F.col("_metadata.file_path").alias("file"))
    if files.isEmpty():
        return None, []
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).where(F.col("_metadata.file_size") > WHOLE)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    blocks = kept(text.mapInPandas(_blocks, "file string, block long, n long, filled long, valid boolean, object boolean"))
    whole = blocks.groupBy("file").agg(F.min("valid").alias("valid"), F.sum("filled").alias("filled"), F.min_by("object", F.when(F.col("filled") > 0, F.col("block"))).alias("object"))
    mine = whole.where(F.col("valid") & (F.col("filled") > 1) & F.col("object")).join(files, "file").select("file", "path")
    found = [r["file"] for r in mine.collect()]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.join(mine, "file").select("file", "block", "path", before.alias("before"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], int] = {}
        for part in parts:
            for i in range(0, len(part), 1000):
                some, rows = part[i : i + 1000], []
                for name, block, start, line in zip(some["path"], some["block"], some["before"], some["value"], strict=True):
                    at = seen[name, block] = seen.get((name, block), start - 1) + 1
                    rows.extend((name, "lines", *x) for x in _line_records(bytes(line), at, fallback))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return text.join(F.broadcast(starts), ["file", "block"]).select("path", "block", "before", "value").mapInPandas(read, RECORD), found


def folder_records(spark: SparkSession, path: str, fallback: str = "gb18030") -> DataFrame:
    """RECORD rows of all files below a folder: record is JSON, '' where there is an error."""
    shipped(spark)
    lines, apart = large_lines(spark, path, fallback)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                rows, shape = [], ""
                try:
                    shape = shape_of(bytes(data))
                    for x in _records(shape, bytes(data), fallback):
                        rows.append((name, shape, *x))
                except Exception as e:  # noqa: BLE001
                    rows = [(name, shape, "", 0, "", f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if apart:
        files = files.where(~F.col("_metadata.file_path").isin(apart))
    whole = files.select("path", "content").mapInPandas(read, RECORD)
    return whole.unionByName(lines) if apart else whole


def as_questions(records: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """path, shape, at, error and a column for each field: the first of its names that a record has with a value, as text.

    Lists stay JSON text. Names are compared as they stand.
    """
    held = F.try_parse_json("record")
    fields = F.try_variant_get(held, "$", "map<string,variant>")
    text = lambda v: F.coalesce(F.nullif(F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.nullif(F.to_json(v), F.lit("null"))), F.lit("")))
    return records.select("path", "shape", "at", "error", *(F.coalesce(*(text(F.try_element_at(fields, F.lit(n))) for n in found)).alias(f) for f, found in names.items()))

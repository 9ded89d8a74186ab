"""Documents cut into overlapping windows and into structural blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

SIZE, OVERLAP = 500, 50


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, chunk_text and any other columns: windows of `size` characters, each `overlap` into the last.

    Windows are stripped and blank ones go; indices number those made, from 0. Null and empty texts have none. The
    windows of a document are made where it is read: no shuffle.
    """
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.char_length("text") - size) / F.lit(float(step)))).cast("int")
    made = F.transform(F.sequence(F.lit(0), n), lambda i: strip(F.substring(F.col("text"), i * step + 1, F.lit(size))))
    kept = F.filter(made, lambda x: x != "")
    rest = [c for c in docs.columns if c not in ("text", "chunk_index", "chunk_text")]
    # an inner posexplode would first be asked whether the list is empty, and so make it twice
    return docs.where("text IS NOT NULL").select(*rest, F.posexplode_outer(kept).alias("chunk_index", "chunk_text")).where("chunk_text IS NOT NULL")


def line_kind(line: Column) -> Column:
    return F.when(line.rlike("^#{1,6} "), "heading").when(line.rlike(r"^\|.*\|$"), "table").when(line.rlike(r"^\$\$|^\\\["), "formula").when(F.trim(line) == "", "blank").otherwise("paragraph")


def blocks(docs: DataFrame, unit: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, block, kind, title, text: neighbouring lines of one kind under one heading, each formula alone.

    The heading is the last one seen above. A unit's lines meet in one task, in order: a document, or a page of it.
    """
    lines = docs.where("text IS NOT NULL").select(*unit, F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("kind", line_kind(F.col("line")))
    by = Window.partitionBy(*unit).orderBy("at")
    lines = lines.withColumn("title", F.last(F.when(F.col("kind") == "heading", F.regexp_replace("line", "^#+ ", "")), True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    new = (F.lag("kind").over(by).isNull() | (F.lag("kind").over(by) != F.col("kind")) | (F.col("kind") == "formula") | (F.col("kind") == "heading")).cast("int")
    lines = lines.withColumn("block", F.sum(new).over(by))
    lines = lines.where(~F.col("kind").isin("blank", "heading"))
    return lines.groupBy(*unit, "block", "kind", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, page, chunk_index (from 0 in each page), chunk_text, kind, title: of pages (doc_id, page, text).

    Neighbouring paragraphs under one heading are one run, a table or formula is one of its own; a run longer than `size`
    is cut into windows. Nothing crosses a page, so pages are the unit of work: one huge file is spread over tasks, and
    only a page's lines meet. Null and blank pages have no chunks; pages of one number in one document are one page.
    """
    unit = ("doc_id", "page")
    found = blocks(pages, unit)
    by = Window.partitionBy(*unit).orderBy("block")
    joins = (F.col("kind") == "paragraph") & (F.lag("kind").over(by) == "paragraph") & F.lag("title").over(by).eqNullSafe(F.col("title"))
    found = found.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(by))
    runs = found.groupBy(*unit, "run", "kind", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    made = windows(runs, size, overlap)
    return made.select(*unit, (F.row_number().over(Window.partitionBy(*unit).orderBy("run", "chunk_index")) - 1).alias("chunk_index"), "chunk_text", "kind", "title")

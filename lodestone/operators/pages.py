"""Printed page numbers: calibration runs from observations, the usual offset, and the map they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP, FIRM = 12, 3


def calibration_runs(seen: DataFrame) -> DataFrame:
    """Runs of one offset from observations (library_id, pdf_page, printed_page).

    Observations without a printed number (null) support no run and contradict none. Pages with several printed values
    are left out; a run goes on while the offset stays and the next page is at most GAP on; runs of one page go, and of
    two unless adjacent. FIRM pages or more make a run sure.
    """
    clean = seen.groupBy("library_id", "pdf_page").agg(F.min("printed_page").alias("printed_page"), F.max("printed_page").alias("other")).where("printed_page = other").withColumn("offset", F.col("pdf_page") - F.col("printed_page"))
    by = Window.partitionBy("library_id").orderBy("pdf_page")
    new = (F.lag("offset").over(by).isNull() | (F.lag("offset").over(by) != F.col("offset")) | (F.col("pdf_page") - F.lag("pdf_page").over(by) > GAP)).cast("int")
    runs = clean.withColumn("new", new).withColumn("run", F.sum("new").over(by)).groupBy("library_id", "run", "offset").agg(F.min("pdf_page").alias("pdf_start"), F.max("pdf_page").alias("pdf_end"), F.count("*").alias("support"))
    runs = runs.where((F.col("support") >= FIRM) | ((F.col("support") == 2) & (F.col("pdf_end") == F.col("pdf_start") + 1)))
    return runs.withColumn("confidence", F.when(F.col("support") >= FIRM, "high").otherwise("medium"))


def page_map(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """Every page inside a run with its printed number, but for pages whose observations conflict."""
    odd = seen.groupBy("library_id", "pdf_page").agg(F.count_distinct("printed_page").alias("n")).where("n > 1").select("library_id", "pdf_page")
    pages = runs.select("library_id", "offset", F.explode(F.sequence("pdf_start", "pdf_end")).alias("pdf_page"))
    return pages.join(odd, ["library_id", "pdf_page"], "left_anti").select("library_id", "pdf_page", (F.col("pdf_page") - F.col("offset")).alias("printed_page"))


def usual_offset(seen: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """The most frequent offset of each library, of equal ones that seen on the first page, if seen `least` times."""
    rows = seen.withColumn("offset", F.col("pdf_page") - F.col("printed_page")).where(F.abs("offset") <= most)
    counts = rows.groupBy("library_id", "offset").agg(F.count("*").alias("support"), F.min("pdf_page").alias("first_page")).where(F.col("support") >= least)
    best = Window.partitionBy("library_id").orderBy(F.desc("support"), "first_page")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def rewritten_references(text: Column, changed: Column, before: str = "第", after: str = "页") -> Column:
    """text with the numbers of its page references (`before`, digits, `after`) replaced by a map's, read once from left to
    right: what has been replaced is not looked at again, so pages may swap. Numbers that the map lacks, or has as null,
    stay; so does a text without references. Null stays null; a null map changes nothing."""
    pattern = f"{before}([0-9]{{1,9}}){after}"
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pieces = F.split(text, pattern)
    told = F.transform(numbers, lambda n: F.concat(F.lit(before), F.coalesce(F.try_element_at(changed, n.cast("int")).cast("string"), n), F.lit(after)))
    return F.when(text.isNotNull(), F.array_join(F.zip_with(pieces, told, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), ""))


def offset_applied(rows: DataFrame, offset: Column, of_library: Column, evidence: str = "evidence", prose: str = "explanation") -> DataFrame:
    """rows whose evidence (structs of source_path, pdf_page, source_page) of a library has the printed pages that an offset
    gives, and whose prose names those; `changed` marks them.

    of_library: an array of the library's paths. The physical page is the printed one where it is missing, a printed page
    below 1 is null. In prose, the old page of an item becomes its new one; of several items with one old page the first
    counts.
    """
    page = lambda e: F.coalesce(e["pdf_page"], e["source_page"])
    own = lambda e: F.coalesce(F.array_contains(of_library, e["source_path"]), F.lit(False)) & page(e).isNotNull()
    printed = lambda e: F.when(page(e) - offset > 0, page(e) - offset).cast("int")
    moved = F.filter(F.col(evidence), lambda e: own(e) & e["source_page"].isNotNull() & printed(e).isNotNull() & (e["source_page"] != printed(e)))
    once = F.filter(moved, lambda e, i: ~F.exists(F.slice(moved, F.lit(1), i), lambda x: x["source_page"] == e["source_page"]))
    pairs = F.map_from_entries(F.transform(once, lambda e: F.struct(e["source_page"].cast("int"), printed(e))))
    items = F.transform(F.col(evidence), lambda e: F.struct(e["source_path"].alias("source_path"), F.when(own(e), page(e)).otherwise(e["pdf_page"]).cast("int").alias("pdf_page"), F.when(own(e), printed(e)).otherwise(e["source_page"]).cast("int").alias("source_page")))
    return rows.withColumns({"changed": F.coalesce(F.exists(evidence, own), F.lit(False)), prose: rewritten_references(F.col(prose), pairs), evidence: items})

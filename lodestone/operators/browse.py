"""Filters, facets, roll-ups, pages and checks over question and library tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(review: str | None = None, pipeline: str | None = None, search: str | None = None, subject: str | None = None, tag: str | None = None, source: str | None = None) -> Column:
    """A filter of those conditions that are given. Columns as named here, besides id, prompt_text, tags, suggested,
    question_source, retrieval_status and generation_status.

    pipeline 'matched_generation_error' is a pseudo status: matched, but the generation failed.
    """
    found: list[Column] = []
    if review:
        found.append(F.col("review_status") == review)
    if pipeline == "matched_generation_error":
        found.append((F.col("retrieval_status") == "matched") & F.col("generation_status").isin("validation_error", "provider_error"))
    elif pipeline:
        found.append(F.col("pipeline_status") == pipeline)
    if search:
        found.append(F.contains(F.lower(F.col("id").cast("string")), F.lower(F.lit(search))) | F.contains(F.lower("prompt_text"), F.lower(F.lit(search))))
    if subject:
        found.append(F.col("subject") == subject)
    if tag:
        found.append(F.array_contains("tags", tag) | F.array_contains("suggested", tag))
    if source:
        found.append(F.col("question_source") == source)
    return reduce(lambda a, b: a & b, found, F.lit(True))


def with_ids(rows: DataFrame, ids: Sequence | None, key: str = "id") -> DataFrame:
    """None keeps all rows, an empty list none."""
    return rows if ids is None else rows.where(F.col(key).isin(*ids) if ids else F.lit(False))


def page(rows: DataFrame, order: list, offset: int, limit: int, most: int = 500) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def listed(rows: DataFrame) -> DataFrame:
    """With all_tags, tags and then those suggested ones that are not among them, and a grade where none is stored."""
    grade = F.coalesce("grade", F.when(F.col("generation_mode") == "textbook", "A").when(F.col("generation_mode") == "textbook_reasoning", "B").when(F.col("generation_mode") == "general_knowledge", "C").otherwise(""))
    return rows.withColumns({"all_tags": F.concat("tags", F.array_except("suggested", "tags")), "grade": grade})


def rollup(parents: DataFrame, children: DataFrame, key: str, measures: dict[str, Column], residual: Column | None = None) -> DataFrame:
    """Parents with measures over their children; those without any have 0. residual filters children, never parents.

    Children are aggregated before the join, so a hot parent costs one row per task.
    """
    kept = children if residual is None else children.where(residual)
    sums = kept.groupBy(key).agg(*(c.alias(n) for n, c in measures.items()))
    return parents.join(sums, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in measures})


def counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts, in one pass."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def stage_report(pages: DataFrame, chunks: DataFrame, page_key: list[str]) -> DataFrame:
    """One row: whether pages are gapless from 1, dimensions agree, and how many chunks lack their page.

    pages: page_number, error; chunks: page_key and dim (null: no vector).
    """
    p = pages.agg(F.count("*").alias("n_pages"), F.coalesce(F.min("page_number") == 1, F.lit(False)).alias("from_one"), F.coalesce(F.max("page_number") == F.count("*"), F.lit(False)).alias("to_last"), F.count_if(F.col("error") != "").alias("n_errors"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("dim").isNull()).alias("n_null"), F.coalesce(F.min("dim") == F.max("dim"), F.lit(True)).alias("one_dim"))
    orphans = chunks.join(pages, page_key, "left_anti").agg(F.count("*").alias("n_orphans"))
    facts = {n: d.select(n).scalar() for d in (p, c, orphans) for n in d.columns}
    one = pages.sparkSession.range(1).select(*(v.alias(n) for n, v in facts.items()))
    return one.withColumn("valid", F.col("from_one") & F.col("to_last") & F.col("one_dim") & (F.col("n_null") == 0) & (F.col("n_orphans") == 0))


def compatibility(libraries: DataFrame, files: DataFrame, fingerprint: str) -> DataFrame:
    """compatible, unknown or stale for each library, by its files' index fingerprints."""
    state = F.when(F.col("index_fingerprint") == fingerprint, 2).when(F.coalesce("index_fingerprint", F.lit("")) == "", 1).otherwise(0)
    worst = files.groupBy("library_id").agg(F.min(state).alias("state"))
    return libraries.join(worst, "library_id", "left").withColumn("compatibility", F.when(F.col("state") == 2, "compatible").when(F.col("state").isNull() | (F.col("state") == 1), "unknown").otherwise("stale")).drop("state")


def searched(trash: DataFrame, needle: str, fields: list[str], offset: int, limit: int) -> DataFrame:
    """Trash whose fields, or the prompt inside the snapshot, hold the needle; the newest first."""
    n = F.lower(F.lit(needle))
    texts = [F.col(f).cast("string") for f in fields] + [F.get_json_object("snapshot", "$.prompt_text")]
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(t), n), F.lit(False)) for t in texts))
    return trash.where(hit).orderBy(F.desc("deleted_at"), "id").offset(offset).limit(limit)

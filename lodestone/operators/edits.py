"""Edits of question rows, each a function from snapshot to snapshot; reviews append events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedupe, strip


def where(rows: DataFrame, chosen: Column, **changes: Column | str) -> DataFrame:
    """rows with columns changed where a condition holds."""
    hit = F.coalesce(chosen, F.lit(False))
    return rows.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def queued(rows: DataFrame, chosen: Column, keep_retrieval: bool = False) -> DataFrame:
    """Back to the queue; with keep_retrieval only matched rows with evidence, whose retrieval stays."""
    if keep_retrieval:
        return where(rows, chosen & (F.col("retrieval_status") == "matched") & (F.col("n_evidence") > 0), pipeline_status="queued", generation_status="pending")
    return where(rows, chosen, pipeline_status="queued", retrieval_status="pending", generation_status="pending")


def subject_changed(rows: DataFrame, chosen: Column, subject: str, bulk: bool) -> DataFrame:
    """Another subject and back to the queue; in bulk the review is reset too."""
    done = queued(where(rows, chosen, subject=subject), chosen)
    return where(done, chosen, review_status="pending") if bulk else done


def knowledge_points(c: Column, most: int = 3) -> tuple[Column, Column]:
    """(points, error): parts of two characters or more, cut to 60, each once; more than `most` is an error."""
    parts = dedupe(F.filter(F.transform(F.split(c, "[,，、;；|\n]"), lambda x: F.substring(strip(x), 1, 60)), lambda x: F.char_length(x) >= 2))
    return F.slice(parts, 1, most), F.when(F.size(parts) > most, "too many").otherwise("")


def extended(rows: DataFrame, name: str, value: Column, column: str = "extensions") -> DataFrame:
    """One entry of a map column set; the last value wins."""
    new = F.create_map(F.lit(name), value.cast("string"))
    kept = F.map_filter(F.coalesce(column, F.create_map().cast("map<string,string>")), lambda k, v: k != name)
    return rows.withColumn(column, F.map_concat(kept, new))


def reviewed(rows: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, events) after actions (id, action, note): approval needs a row that was viewed and has a text."""
    found = rows.join(actions, "id", "left")
    fit = (F.col("action") != "approved") | (F.col("viewed_at").isNotNull() & (F.trim("explanation") != ""))
    good = F.col("action").isin("approved", "rejected", "pending") & F.coalesce(fit, F.lit(False))
    done = found.withColumn("review_status", F.when(good, F.col("action")).otherwise(F.col("review_status"))).drop("action", "note")
    return done, found.where(good).select("id", "action", F.substring(F.coalesce("note", F.lit("")), 1, 2000).alias("note"))


def reconciled(rows: DataFrame, threshold: float, marker: str, confidence: Column) -> DataFrame:
    """Unmatched rows of a high score with evidence, whose message does not say 'below', were in truth failed validations."""
    t = min(0.99, max(0.0, threshold))
    hit = (F.col("pipeline_status") == "unmatched") & (F.col("match_score") >= t) & (F.col("n_evidence") > 0) & ~F.contains(F.coalesce("error_message", F.lit("")), F.lit(marker))
    return where(rows, hit, pipeline_status="error", retrieval_status="matched", generation_status="validation_error", match_confidence=confidence)


def unusable(rows: DataFrame, placeholders: list[str]) -> DataFrame:
    """Generated rows without a usable text, blocks or (from a textbook) evidence are failed; placeholder texts are cleared."""
    text = F.trim(F.coalesce("explanation", F.lit("")))
    holder = F.lit(False)
    for p in placeholders:
        holder = holder | text.startswith(p)
    bad = (F.col("pipeline_status") == "generated") & ((text == "") | holder | text.startswith("{") | (F.col("n_blocks") == 0) | ((F.col("generation_mode") != "general_knowledge") & (F.col("n_evidence") == 0)))
    done = where(rows, bad & holder, explanation="")
    return where(done, bad, pipeline_status="error", generation_status="validation_error")


def first_seen(rows: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """viewed_at of chosen rows, once."""
    return where(rows, chosen, viewed_at=F.coalesce("viewed_at", now))


def migrated(old_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, pages, chunks) from flat chunks (source_file, source_page, chunk_index, chunk_text, embedding)."""
    files = old_chunks.groupBy("source_file").agg(F.count_distinct("source_page").alias("page_count"), F.count("*").alias("n_chunks"))
    pages = old_chunks.groupBy("source_file", "source_page").agg(F.sum(F.char_length("chunk_text")).alias("char_count"))
    return files, pages, old_chunks.select("source_file", "source_page", "chunk_index", "chunk_text", "embedding", F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"))

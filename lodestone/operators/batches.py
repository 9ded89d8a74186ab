"""Batches of questions from many files: checked against what is there and against each other, mended, and put in.

A draft is a table of items (draft_id, ordinal, source, number, bank, id, core, content, answer, errors, status, reason);
each step is a function from snapshot to snapshot. Items without a row have errors and stay issues. Empty batches give
empty drafts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import classify

BANKS = ("school", "kaoyan")
FIELDS = ("bank", "id", "core", "content", "answer")


def with_defaults(rows: DataFrame, defaults: dict[str, str], core: Column) -> DataFrame:
    """Blank fields get a profile's defaults, and a blank id one made of `core`, which stands for the content."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rows = rows.withColumns({k: F.when(blank(k), F.lit(v)).otherwise(F.col(k)) for k, v in defaults.items()})
    return rows.withColumn("id", F.when(blank("id"), F.concat(F.lit("import_"), F.substring(F.sha2(core, 256), 1, 24))).otherwise(F.col("id")))


def preview(items: DataFrame, existing: DataFrame, draft: str) -> DataFrame:
    """items (ordinal, source, number, FIELDS, errors) as a draft, judged by what `existing` (FIELDS) and they hold.

    An item is an issue if it has errors, no id (see with_defaults), no known bank, or the id or core of a row that differs; a duplicate if such a
    row is the same; else ready. Rows that exist come before all items and are never changed.
    """
    known = F.col("bank").isin(*BANKS)
    errors = F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.when(F.coalesce(known, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("no bank"))))
    errors = F.concat(errors, F.when(F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) == "", F.array(F.lit("no id"))).otherwise(F.array().cast("array<string>")))
    rows = items.select("ordinal", "source", "number", *FIELDS).withColumn("errors", errors) if "errors" not in items.columns else items.select("ordinal", "source", "number", *FIELDS, errors.alias("errors"))
    old = existing.select(F.lit(-1).cast("long").alias("ordinal"), *FIELDS, F.lit(True).alias("valid"))
    judged = classify(old.unionByName(rows.select(F.col("ordinal").cast("long").alias("ordinal"), *FIELDS, (F.size("errors") == 0).alias("valid")))).where("ordinal >= 0")
    found = rows.join(judged.select("ordinal", "status", "reason"), "ordinal")
    return found.withColumn("reason", F.when(F.size("errors") > 0, F.array_join("errors", "; ")).otherwise(F.col("reason"))).withColumn("draft_id", F.lit(draft))


def resume(draft: DataFrame, corrections: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """The draft judged again, with corrections (ordinal, FIELDS, errors) of items that were issues; others are refused."""
    wrong = corrections.join(draft.where("status = 'issue'"), "ordinal", "left_anti").limit(1).count()
    if wrong:
        raise ValueError("only issues can be corrected")
    new = corrections.select("ordinal", *(F.col(c).alias(f"_{c}") for c in (*FIELDS, "errors")), F.lit(True).alias("_new"))
    rows = draft.join(new, "ordinal", "left")
    rows = rows.select("ordinal", "source", "number", *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS), F.when(F.col("_new"), F.col("_errors")).otherwise(F.filter("errors", lambda e: e != "no bank")).alias("errors"))
    return preview(rows, existing, name)


def summary(draft: DataFrame) -> DataFrame:
    """One row per draft: total, ready, duplicates, issues."""
    n = lambda s: F.count_if(F.col("status") == s)
    return draft.groupBy("draft_id").agg(F.count("*").alias("total"), n("ready").alias("ready"), n("duplicate").alias("duplicates"), n("issue").alias("issues"))


def committed(draft: DataFrame, title: str) -> tuple[DataFrame, DataFrame]:
    """(sets, questions): the ready items as question rows, those of each bank in a new set named by the batch and bank.

    Judge the draft again by preview() or resume() in the same step, so that a stale one cannot put a row in twice.
    """
    ready = draft.where("status = 'ready'").withColumn("set_id", F.sha2(F.concat_ws("\x1f", "draft_id", "bank"), 256))
    sets = ready.groupBy("set_id", "bank", "draft_id").agg(F.count("*").alias("question_count"))
    sets = sets.select("set_id", F.concat(F.lit(f"{title} · "), "bank").alias("name"), F.concat(F.lit("batch://"), "draft_id").alias("source_path"), F.lit("batch").alias("source_type"), "question_count")
    return sets, ready.select("set_id", F.col("id").alias("external_id"), "bank", "core", "content", "answer", "ordinal")

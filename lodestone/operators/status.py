"""State changes as pure functions from snapshot to snapshot; nothing is updated in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decided(status: Column, general: Column, has_evidence: Column, validation: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """(retrieval, generation, confidence) after a result. validation: the error is one of validation; confidence: of stored evidence."""
    made, failed = status == "generated", (status == "error") & has_evidence
    retrieval = F.when(made & general, F.when(has_evidence, "unmatched").otherwise("no_library")).when(made | failed, "matched").when(status.isin("unmatched", "no_library"), status).otherwise("error")
    generation = F.when(made, "generated").when(failed, F.when(validation, "validation_error").otherwise("provider_error")).otherwise("pending")
    level = F.when(made & general, F.when(has_evidence, "low").otherwise("no_library")).when(made | failed, confidence).when(status == "unmatched", "low").when(status == "no_library", "no_library").otherwise("error")
    return retrieval, generation, level


def backfilled(status: Column, general: Column, has_evidence: Column, validation: Column, below: Column, score: Column, confidence: Column, rescue: float = 0.60) -> tuple[Column, Column, Column, Column]:
    """(pipeline, retrieval, generation, confidence) of rows that have one old status only. below: the message says so."""
    known = status.isin("generated", "unmatched", "no_library", "error")
    saved = (status == "unmatched") & has_evidence & (validation | (score >= rescue)) & ~below
    now = F.when(saved, "error").otherwise(status)
    retrieval, generation, level = decided(now, general, has_evidence, validation | saved, confidence)
    pending = lambda c: F.when(known, c).otherwise("pending")
    return now, pending(retrieval), pending(generation), pending(level)


def reclassified(rows: DataFrame, threshold: float) -> DataFrame:
    """Pending generated rows below the threshold (held to 0..1), unless from general knowledge, become unmatched and low."""
    t = min(1.0, max(0.0, threshold))
    falls = (F.col("review_status") == "pending") & (F.col("pipeline_status") == "generated") & (F.col("generation_mode") != "general_knowledge") & (F.col("match_score") < t)
    change = {"pipeline_status": "unmatched", "retrieval_status": "unmatched", "generation_status": "pending", "match_confidence": "low"}
    return rows.withColumns({c: F.when(falls, v).otherwise(F.col(c)) for c, v in change.items()})


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those of the same key, and new keys added."""
    return base.join(changes, keys, "left_anti").unionByName(changes)


def inserted(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of new whose key it lacks."""
    return base.unionByName(new.join(base, keys, "left_anti"))


def patched(base: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """base with the non-null fields of patches (keys and some of its columns) instead of its own."""
    fields = [c for c in patches.columns if c not in keys]
    named = patches.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields))
    return base.join(named, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def trashed(rows: DataFrame, deleted_at: Column, days: int = 30) -> DataFrame:
    """Snapshots of rows as JSON, with the time after which they may be purged (a day at least)."""
    return rows.select(*rows.columns, F.to_json(F.struct(*rows.columns)).alias("snapshot"), deleted_at.alias("deleted_at"), (deleted_at + F.make_dt_interval(F.lit(max(1, days)))).alias("purge_after"))


def purged(trash: DataFrame, now: Column) -> DataFrame:
    return trash.where(F.col("purge_after") > now)


def restorable(trash: DataFrame, live: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Trash rows with `problem`: a live row has the key again, the parent is gone, or none."""
    taken = live.select(key).distinct().withColumn("_taken", F.lit(True))
    there = parents.select(parent).distinct().withColumn("_there", F.lit(True))
    found = trash.join(taken, key, "left").join(there, parent, "left")
    return found.withColumn("problem", F.when(F.col("_taken"), "exists").when(F.col("_there").isNull(), "no parent").otherwise("")).drop("_taken", "_there")


def approved(rows: DataFrame, eligible: Column, expected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with expected and eligible ones approved, and one row of counts: approved, skipped."""
    marked = rows.join(expected.select(key).distinct().withColumn("_expected", F.lit(True)), key, "left")
    good = F.coalesce(F.col("_expected") & eligible, F.lit(False))
    counts = marked.agg(F.count_if(good).alias("approved"), F.count_if(F.coalesce("_expected", F.lit(False)) & ~good).alias("skipped"))
    return marked.withColumn("review_status", F.when(good, "approved").otherwise(F.col("review_status"))).drop("_expected"), counts


def snapshot_token(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """A token of each group's state for optimistic updates, by sums of row hashes: no group is gathered in one place."""
    h = reduce(lambda a, b: a + b, (F.xxhash64(F.lit(i), *fields).cast("decimal(38,0)") for i in range(1)))
    g = F.xxhash64(F.lit(99), *fields).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws(":", F.sum(h).cast("string"), F.sum(g).cast("string"), F.count("*").cast("string")), 256).alias("token"))

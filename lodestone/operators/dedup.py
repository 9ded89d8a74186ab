"""Exact duplicates, conflicts and occurrence ids of question rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def occurrence_ids(rows: DataFrame, parts: list[Column], order: str, prefix: str = "q-") -> DataFrame:
    """`occurrence` (1, 2, ... among rows of one content, in order) and `row_id`: a content hash, with -n from the second on."""
    rows = rows.withColumn("_digest", F.substring(fingerprint(*parts), 1, 16)).withColumn("occurrence", F.row_number().over(Window.partitionBy("_digest").orderBy(order)))
    suffix = F.when(F.col("occurrence") > 1, F.concat(F.lit("-"), F.col("occurrence").cast("string"))).otherwise("")
    return rows.withColumn("row_id", F.concat(F.lit(prefix), F.col("_digest"), suffix)).drop("_digest")


def classify(batch: DataFrame) -> DataFrame:
    """status of each row (ordinal, bank, id, core, content, answer, valid): ready, duplicate or issue, and the reason.

    Neighbours of a row share its (bank, id) or its core. Invalid rows are issues and no one's neighbour. If neighbours
    differ in content, all are issues, of the answer if answers differ; if all are the same, the first is ready and the
    rest are duplicates. Both keys are grouped with partial aggregates and joined back; there is no OR join.
    """
    valid = batch.where("valid")
    facts = lambda k: valid.groupBy(*k).agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.min("answer").alias("alo"), F.max("answer").alias("ahi"), F.min("ordinal").alias("first"))
    by_id = facts(["bank", "id"]).select("bank", "id", F.struct("lo", "hi", "alo", "ahi", "first").alias("i"))
    by_core = facts(["core"]).select("core", F.struct("lo", "hi", "alo", "ahi", "first").alias("c"))
    rows = batch.join(by_id, ["bank", "id"], "left").join(by_core, "core", "left")
    differs = (F.col("i.lo") != F.col("i.hi")) | (F.col("c.lo") != F.col("c.hi"))
    answers = (F.col("i.alo") != F.col("i.ahi")) | (F.col("c.alo") != F.col("c.ahi"))
    first = F.least("i.first", "c.first") == F.col("ordinal")
    reason = F.when(~F.col("valid"), "invalid").when(differs & answers, "answer conflict").when(differs, "content conflict").when(~first, "duplicate").otherwise("")
    status = F.when(reason.isin("invalid", "answer conflict", "content conflict"), "issue").when(reason == "duplicate", "duplicate").otherwise("ready")
    return rows.select("ordinal", "bank", "id", status.alias("status"), reason.alias("reason"))


def import_stats(rows: DataFrame, digest: str, complete: Column) -> DataFrame:
    """One row: rows, importable ones, missing ones, groups of duplicates and the rows in them."""
    groups = rows.groupBy(digest).agg(F.count("*").alias("n"), F.sum(complete.cast("long")).alias("ok"))
    return groups.agg(F.sum("n").alias("row_count"), F.sum("ok").alias("importable"), (F.sum("n") - F.sum("ok")).alias("missing"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))

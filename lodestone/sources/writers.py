"""Writers: envelopes, splits by subject, issue lists, flat sheets, staged publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = "[\x00-\x08\x0b\x0c\x0e-\x1f]"
CELL = 32_767


def export_json(rows: DataFrame, path: str, by: str | None = None, missing: str = "none") -> None:
    """Rows as JSON lines, in folders by a column if asked; blank values of it go to `missing`. Spark commits on success only."""
    if by is None:
        rows.write.mode("overwrite").json(path)
        return
    named = rows.withColumn(f"{by}_folder", F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit(missing)))
    named.repartition(f"{by}_folder").write.mode("overwrite").partitionBy(f"{by}_folder").json(path)


def export_issues(rows: DataFrame, path: str, status: str = "pipeline_status") -> None:
    """Rows that are unmatched, lack a library or failed, as CSV with a header."""
    rows.where(F.col(status).isin("unmatched", "no_library", "error")).write.mode("overwrite").option("header", True).csv(path)


def cells(rows: DataFrame) -> DataFrame:
    """Text columns fit for a spreadsheet: no control characters, at most CELL characters."""
    kinds = dict(rows.dtypes)
    return rows.select(*(F.substring(F.regexp_replace(c, CONTROL, ""), 1, CELL).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns))


def sheets(questions: DataFrame) -> dict[str, DataFrame]:
    """Questions (id, scalar fields, blocks, evidence) as flat tables: questions, blocks, evidence."""
    nested = [c for c, k in questions.dtypes if k.startswith("array<struct")]
    flat = {c: cells(questions.select("id", F.posexplode(c).alias("at", "x")).select("id", "at", "x.*")) for c in nested}
    return {"questions": cells(questions.drop(*nested)), **flat}


def publish(rows: DataFrame, path: str, key: str, report: DataFrame) -> bool:
    """Replaces the partitions of path that rows has, if the one row of report is valid; other partitions stay,
    also those of keys that have no rows left: versions.commit() replaces keys, and lets such ones go."""
    if not report.select("valid").first()[0]:
        return False
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return True


def remapped(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows with ids replaced by those of a table (old, new); `changed` marks them."""
    found = rows.join(ids.select(F.col("old").alias(key), "new"), key, "left")
    return found.withColumn("changed", F.col("new").isNotNull()).withColumn(key, F.coalesce("new", key)).drop("new")

"""Incremental export: what changed in approved rows against the snapshot taken at import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preflight(current: DataFrame, baseline: DataFrame, key: str, core: list[str], learning: list[str]) -> DataFrame:
    """key, outcome (issue, unchanged, patch), reason, fields (changed learning fields) and base_values of them.

    A row with errors (a list, if current has that column), without a baseline, or with a change of its core is an issue.
    """
    old = baseline.select(key, F.struct(*core, *learning).alias("old"))
    rows = current.join(old, key, "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old.{c}"))
    moved = reduce(lambda a, b: a | b, (differs(c) for c in core))
    fields = F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in learning)))
    values = F.filter(F.array(*(F.when(differs(c), F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").cast("string").alias("value"))) for c in learning)), lambda x: x.isNotNull())
    invalid = F.size("errors") > 0 if "errors" in current.columns else F.lit(False)
    reason = F.when(invalid, "invalid").when(F.col("old").isNull(), "no baseline").when(moved, "core changed").otherwise("")
    outcome = F.when(reason != "", "issue").when(F.size(fields) == 0, "unchanged").otherwise("patch")
    empty = F.array().cast("array<string>")
    return rows.select(key, outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "patch", fields).otherwise(empty).alias("fields"), F.when(outcome == "patch", values).alias("base_values"))

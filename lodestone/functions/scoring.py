"""Scores, tiers and grades of retrieved evidence as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, summed in double precision; 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def tiers(threshold: float) -> tuple[float, float, float]:
    """Least top score to be strong, least score of each of two that agree, least score of support."""
    return max(0.70, threshold + 0.10), max(0.65, threshold + 0.05), max(0.55, threshold - 0.05)


def match_confidence(scores: Column, threshold: float) -> Column:
    """low, standard or strong from a match's scores."""
    strong, agree, _ = tiers(threshold)
    top = F.array_max(scores)
    return F.when((F.size(scores) == 0) | top.isNull() | (top < threshold), "low").when((top >= strong) | (F.size(F.filter(scores, lambda s: s >= agree)) >= 2), "strong").otherwise("standard")


def stored_confidence(match_score: Column, scores: Column) -> Column:
    """Of stored evidence: fixed limits, whatever threshold was in use, and never low."""
    everything = F.concat(F.array(match_score), scores)
    return F.when((F.array_max(everything) >= 0.70) | (F.size(F.filter(scores, lambda s: s >= 0.65)) >= 2), "strong").otherwise("standard")


def evidence_grade(confidence: Column, first_score: Column, threshold: float, covered: Column, n_terms: Column) -> Column:
    """A if strong with enough of the query's terms in the text, C below the threshold, else B."""
    enough = covered >= F.least(F.lit(2), F.greatest(F.lit(1), n_terms))
    return F.when(first_score.isNull() | (first_score < threshold), "C").when((confidence == "strong") & enough, "A").otherwise("B")


def hybrid_score(cosine_: Column, rerank: Column, alpha: Column | float) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * (cosine_ + 1) / 2 + (1 - a) * rerank


def generation_route(hard: Column, case: Column, grade_b: Column, calculation: Column, n_answers: Column, length: Column) -> tuple[Column, Column, Column]:
    """Complexity points, the tier they lead to (pro, thinking, fast), and their reasons in order."""
    rules = [(hard, 3, "hard"), (case, 2, "case"), (grade_b, 2, "grade_b"), (calculation, 2, "calculation"), (n_answers >= 3, 1, "answers"), (length >= 320, 1, "long")]
    points = reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n, _ in rules))
    return points, F.when(points >= 3, "pro").when(points >= 1, "thinking").otherwise("fast"), F.array_compact(F.array(*(F.when(c, r) for c, _, r in rules)))


def duty(reasons: list[tuple[Column, str]], passed: str = "") -> Column:
    """The first reason that holds, in order. What cannot be told, because a field is null, holds: a gate stays shut."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), r) for c, r in reasons), F.lit(passed))

"""Audit of filters' interaction: what each of five filters removes in every order in which they can be applied.

Direct replay: each document carries the flags of the filters that it fails. Documents are crossed with the table of all
120 orders (a broadcast of fixed size), the first step at which a document fails is found from its flags, its five steps
are exploded, and counts are summed by part, order and step, with map-side combining: a task sends at most 600 rows a part,
however many documents it has and however they are spread over parts. Everything is built-in functions in the JVM.

The flag of a repeated text needs the smallest id of each text: texts are grouped by a 256-bit digest with map-side
combining, and only groups that have a repeat are joined back, slim rows without texts, which skew handling can split.

Null texts count as empty (so they equal each other and the empty text), null parts as the empty string. A row without an
id fails the repeat filter under no circumstances, makes no other row fail it, and has no labels; rows repeated under one id
do not fail it for each other. An id labelled more than once is good, or toxic, if any of its rows says so. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def conditions(text: Column) -> dict[str, Column]:
    """When the filters A to D fail a text; E is not a matter of the text alone."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < FEW_WORDS,
        "B": F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(DISTINCT_PERCENT) * n.cast("long"),
        "C": F.lit(100) * capitals.cast("long") > F.lit(CAPITAL_PERCENT) * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, fails, good, toxic) for each document; fails: an array of booleans, one for each filter."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("last") > F.col("first")).select("digest", "first")
    rows = rows.select("id", "part", "digest", *(c.alias(k) for k, c in conditions(F.col("text")).items())).join(first, "digest", "left")
    rows = rows.withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "id", "left")
    return rows.select("part", F.array(*FILTERS).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def replayed(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of rows (part, fails, good, toxic) over all orders of the filters."""
    orders = rows.sparkSession.createDataFrame([("".join(p), [filters.index(x) for x in p]) for p in permutations(filters)], "filter_order string, places array<int>")
    # the first step, from 1, whose filter fails the document; none: one beyond the last
    steps = F.transform("places", lambda i: F.get("fails", i))
    lost = F.coalesce(F.nullif(F.array_position(steps, True), F.lit(0)), F.lit(len(filters) + 1))
    n_fails = F.size(F.filter("fails", lambda x: x))
    replay = rows.withColumn("n_fails", n_fails).crossJoin(F.broadcast(orders)).select("part", "filter_order", "good", "toxic", "n_fails", steps.alias("steps"), lost.cast("int").alias("lost"))
    replay = replay.select("part", "filter_order", "good", "toxic", "n_fails", "lost", F.posexplode("steps").alias("at", "fails")).withColumn("step", F.col("at") + 1)
    count = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    here = F.col("lost") == F.col("step")
    summed = replay.groupBy("part", "filter_order", "step").agg(
        count(F.col("lost") > F.col("step")).alias("kept"),
        count(here).alias("removed"),
        count(F.col("fails") & (F.col("lost") < F.col("step"))).alias("redundant"),
        count(F.col("fails") & (F.col("n_fails") == 1)).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
    )
    # 600 rows a part
    return summed.withColumn("shapley", F.expr("sum(removed) OVER (PARTITION BY part, substring(filter_order, step, 1))"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant and further counts of documents."""
    return replayed(flagged(docs, labels, part))

"""Connected components of an undirected graph, by alternating large-star and small-star steps over DataFrames.

Labels are the smallest node of a component. Nothing is collected; every round is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop_cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large(edges: DataFrame, least: DataFrame) -> DataFrame:
    """least: a table, so that its join, where a node of many neighbours is hot, has plain sides that skew handling splits."""
    return edges.union(edges.select("b", "a")).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b <> m").select("b", "m").union(least).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b); a node without edges other than to itself is not listed."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        # both steps keep each edge's first node the larger
        every = now.union(now.select("b", "a")).union(now.select("b", "b"))
        least = cut(every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        made = cut(_small(_large(now, least)))
        drop_cut(now)
        drop_cut(least)
        before, now, state = state, made, _state(made)
        if state == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

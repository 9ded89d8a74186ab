"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the total, over its present size. Each document gets a number in
[0, 1) from a hash of seed and doc_id, and its count of copies is the Poisson quantile of that number at its source's
rate: the same on every run, independent of order and partitioning, with the rate as its mean. Documents are exploded
by count and the copies shuffled globally, by a second hash of seed, doc_id and copy number.

Sizes are UTF-8 bytes of the text plus 1; they are summed per source before any shuffle, and joined back to documents
by source (broadcast only if counted few, else joined with skew handling). A rate has no upper bound; copies beyond
the last step of the tabulated distribution have a chance below 1e-12 and are not made. Shares default to the power
ALPHA of a source's size, normalised, so that large sources shrink and small ones grow.

Null sources are a source of their own; null texts count as empty. Null ids are hashed as the text null. Rows repeated
under one id get equal counts. Other columns are carried along untouched unless they are called n_copies, rate, copy or
shuffle_key, which this operator makes. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import partitions

ALPHA, SEED = 0.7, 17
DIGITS = 12
BROADCAST_SOURCES = 100_000


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from the first 12 hexadecimal digits of an MD5 over the parts: any SQL engine can make the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def cumulated(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson distribution with this rate, until less than 1e-12 is left."""
    last = F.ceil(rate + 8 * F.sqrt(rate) + 16).cast("int")

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.when(k > 0, F.log(rate) - F.log(k.cast("double"))).otherwise(F.lit(0.0))
        return F.struct(logp.alias("logp"), (acc["sum"] + F.exp(logp)).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + F.exp(logp))).alias("sums"))

    start = F.struct((-rate).alias("logp"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["sums"]))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, alpha: float = ALPHA) -> DataFrame:
    """(source, size, rate): rate = share of the source * epochs * total size / size of the source."""
    spark: SparkSession = docs.sparkSession
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    found = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        found = found.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], T.StructType([T.StructField("name", T.StringType()), T.StructField("weight", T.DoubleType())]))
        found = found.join(given, found.source.eqNullSafe(given.name), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = found.agg(F.sum("weight").alias("w"), F.sum("size").alias("s")).first()
    if not total["w"]:
        return found.select("source", "size", F.lit(0.0).alias("rate"))
    return found.select("source", "size", (F.col("weight") / F.lit(float(total["w"])) * F.lit(float(epochs * total["s"])) / F.col("size")).alias("rate"))


def counted(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs with rate and n_copies."""
    found = rates(docs, weights, epochs, alpha).select(F.col("source").alias("_source"), "rate", cumulated(F.col("rate")).alias("_steps"))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    rows = docs.drop("n_copies", "rate", "_source", "_steps").join(found, docs.source.eqNullSafe(F.col("_source")))
    # the quantile: how many cumulated steps the document's number has reached
    u = uniform(seed, F.col("doc_id"))
    return rows.withColumn("n_copies", F.coalesce(F.size(F.filter("_steps", lambda x: u >= x)), F.lit(0))).drop("_source", "_steps")


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs repeated n_copies times, with copy (from 1) and shuffle_key, dealt and sorted by shuffle_key."""
    rows = counted(docs.drop("copy", "shuffle_key"), weights, epochs, alpha, seed).where("n_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", uniform(seed + 1, F.col("doc_id"), F.col("copy")))
    # the key is uniform, so hashing it deals copies evenly; the sort makes the order within each part random too
    return rows.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")

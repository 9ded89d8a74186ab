"""A corpus pipeline of five stages over `documents`: rules, near duplicates, repeated passages, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and
rereads it as the next stage's docs. All but the last return the columns of documents. Null ids pass every stage and are
never anyone's duplicate; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.cdc import deduplicated
from lodestone.llm.mixing import replicated
from lodestone.llm.partenum import jaccard_components
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.runtime import cut
from lodestone.llm.spm import encoded

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged by a classifier fitted on the labels."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    others = jaccard_components(docs, width=5, num=4, den=5).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that another document, or an earlier place, has already."""
    return deduplicated(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, in a global random order."""
    return replicated(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return encoded(docs, decoded=False).select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("mixing sources", mixture), ("SentencePiece", tokens)]

#: the classifier, the chunk hashes and the pieces have no SQL form; tests/llm holds each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs

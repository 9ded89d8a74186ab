"""Readers: question sets in JSON of several shapes, raw text with its encoding, golden sets, files by content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.questions import flattened

QUESTION = "id string, bank string, subject string, type string, difficulty string, case_info string, question string, options array<string>, answer string, tags array<string>, knowledge_points array<string>"
CHAPTERS = "chapter string, questions array<struct<ID:string,type:string,stem:string,options:array<struct<label:string,content:string>>,answer:string,explanation:string>>"
GOLDEN = "id string, grade string, relevant_chunk_ids array<string>, candidates array<struct<chunk_id:string,cosine:double,rerank_score:double,pdf_page:int,source_path:string>>, question string, answer string, evidence array<string>, degraded boolean"


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def questions_json(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """A plain array of questions, or an object that holds one under `questions` or `data`; what fits no shape is skipped."""
    nested = f"{schema}, questions array<struct<{schema.replace(' ', ':', 0)}>>, data array<struct<{schema}>>"
    rows = spark.read.option("multiLine", True).option("encoding", "UTF-8").schema(nested).json(path)
    inner = rows.where("questions IS NOT NULL OR data IS NOT NULL").select(F.explode(F.coalesce("questions", "data")).alias("q")).select("q.*")
    return rows.where("questions IS NULL AND data IS NULL AND question IS NOT NULL").drop("questions", "data").unionByName(inner)


def chapters_json(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """Chapters of questions; the subject is the file's name."""
    rows = spark.read.option("multiLine", True).schema(CHAPTERS).json(path)
    subject = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return flattened(rows.select(subject.alias("subject"), "chapter", "questions"), labels)


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def raw_text(spark: SparkSession, path: str, fallback: str = "gb18030") -> DataFrame:
    """path and text of whole files: UTF-8, with or without a mark, else the fallback encoding."""
    @F.pandas_udf("string")
    def decoded(data: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            try:
                return raw.decode("utf-8-sig")
            except UnicodeDecodeError:
                return raw.decode(fallback, errors="replace")

        return data.map(one)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", decoded("content").alias("text"))


def identities(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified and SHA-256 of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def column_mapping(header: list[str], aliases: dict[str, str]) -> dict[str, str]:
    """Source column of each field, by names that are equal but for case and white space."""
    fold = lambda x: "".join(x.split()).lower()
    known = {fold(k): v for k, v in aliases.items()}
    return {known[fold(h)]: h for h in reversed(header) if fold(h) in known}


def mapped(rows: DataFrame, mapping: dict[str, str], option_fields: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Spreadsheet rows under field names: blank rows go, option columns become one list, defaults fill blank fields."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    plain = {f: text(s) for f, s in mapping.items() if f not in option_fields}
    options = [text(mapping[f]) for f in option_fields if f in mapping]
    listed = F.array_compact(F.array(*(F.concat(F.lit(f"{chr(65 + i)}. "), o) for i, o in enumerate(options)))) if options else F.array().cast("array<string>")
    out = rows.select(*(F.coalesce(c, F.lit((defaults or {}).get(f))).alias(f) for f, c in plain.items()), listed.alias("options"), F.coalesce(*plain.values(), *options).isNotNull().alias("_some"))
    return out.where("_some").drop("_some")


def register_pages(spark: SparkSession, read_page, n_pages, name: str = "paged") -> None:
    """A data source over paged files, a partition for each range of pages.

    n_pages(path) counts pages; read_page(path, number) returns (text, method, error). No format's library is implied.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Range(InputPartition):
        def __init__(self, first: int, last: int):
            self.first, self.last = first, last

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.step = options["path"], int(options.get("pagesPerPartition", "50"))
            self.start = int(options.get("startPage", "1"))

        def partitions(self):
            return [Range(a, min(a + self.step - 1, n_pages(self.path))) for a in range(self.start, n_pages(self.path) + 1, self.step)]

        def read(self, partition) -> Iterator[tuple]:
            for n in range(partition.first, partition.last + 1):
                yield (n, *read_page(self.path, n))

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "page_number int, text string, method string, error string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Pages)

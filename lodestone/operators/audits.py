"""Selections for repair, citation and usage audits, estimates, regrouped sheets, and folds over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaners import filled


def failures(rows: DataFrame) -> DataFrame:
    """Pending rows that are matched, failed, and have evidence to generate from."""
    return rows.where((F.col("review_status") == "pending") & (F.col("retrieval_status") == "matched") & F.col("generation_status").isin("validation_error", "provider_error") & (F.col("n_evidence") > 0))


def general(rows: DataFrame) -> DataFrame:
    """Pending rows without a match or a library, to be answered from general knowledge."""
    return rows.where((F.col("review_status") == "pending") & F.col("pipeline_status").isin("unmatched", "no_library"))


def lacking(rows: DataFrame, points: str, title: str, body: str) -> DataFrame:
    """Generated rows none of whose nested items has both fields."""
    has = F.exists(points, lambda p: filled(p[title]) & filled(p[body]))
    return rows.where((F.col("pipeline_status") == "generated") & ~F.coalesce(has, F.lit(False)))


def abnormal(rows: DataFrame, markers: list[str]) -> DataFrame:
    """Pending unmatched or failed rows whose message or warnings hold a marker of structural failure."""
    text = F.concat_ws("\n", F.coalesce("error_message", F.lit("")), F.array_join("warnings", "\n"))
    return rows.where((F.col("review_status") == "pending") & F.col("pipeline_status").isin("unmatched", "error") & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)))


def compatible(files: DataFrame, libraries: DataFrame, subject: str, fingerprint: str, profile: dict[str, str]) -> DataFrame:
    """Files of a subject's active libraries whose index is the same, or made in the same vector space."""
    same = F.col("index_fingerprint") == fingerprint
    space = F.lit(True)
    for k, v in profile.items():
        space = space & (F.coalesce(F.element_at("index_profile", k), F.lit("")) == v)
    chosen = libraries.where(F.col("active") & (F.col("subject") == subject)).select("library_id")
    return files.join(chosen, "library_id", "left_semi").where(F.col("status").isin("ready", "warning") & (same | space))


def pending_batch(chunks: DataFrame, size: int) -> DataFrame:
    """The next chunks without a vector, in page order."""
    return chunks.where("embedding IS NULL").orderBy("page_number", "chunk_index").limit(size)


def header_numbers(chunks: DataFrame) -> DataFrame:
    """Pages whose first chunk begins with a line of one to four digits, and that number."""
    number = F.regexp_extract("chunk_text", r"^\s*([0-9]{1,4})\s*\n", 1)
    return chunks.where((F.col("chunk_index") == 0) & (number != "")).withColumn("printed_page", number.cast("int"))


def citation_audit(citations: DataFrame, files: DataFrame) -> DataFrame:
    """state of each citation (id, file, page) against files (file, page_count): ok, skipped, or what is wrong."""
    found = citations.join(files, "file", "left")
    page = F.expr("try_cast(page AS INT)")
    return found.withColumn("state", F.when(F.coalesce(F.trim("page"), F.lit("")) == "", "skipped").when(page.isNull() | (page <= 0), "invalid page").when(F.col("page_count").isNull(), "no file").when(page > F.col("page_count"), "beyond the last page").otherwise("ok"))


def usage(rows: DataFrame, by: list[str], steps: str = "trace") -> DataFrame:
    """Requests and tokens over the steps of rows."""
    tokens = F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s["tokens"])
    return rows.groupBy(*by).agg(F.sum(F.size(steps)).alias("requests"), F.sum(tokens).alias("tokens"))


def estimate(rows: DataFrame, batch: int = 20) -> DataFrame:
    """One row: what a backfill would touch, how much of it is approved, and in how many batches."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.ceil(F.count("*") / batch).alias("batches"))


def once_per(rows: DataFrame, keys: list[str], compute) -> DataFrame:
    """compute(distinct keys) joined back, so equal rows are computed once."""
    return rows.join(compute(rows.select(*keys).distinct()), keys, "left")


def regrouped(questions: DataFrame, blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flat sheets as nested questions: blocks and evidence of each id, in the order of their own number."""

    def nested(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("id", "at")]
        return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))

    return questions.join(nested(blocks, "blocks"), "id", "left").join(nested(evidence, "evidence"), "id", "left")


def from_headings(paragraphs: DataFrame) -> DataFrame:
    """Questions from styled paragraphs (file, at, style, text): H1 a chapter, H2 a question, H3 a field, others its text."""
    by = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda s: F.last(F.when(F.col("style") == s, F.col("text")), True).over(by)
    n = F.sum(F.when(F.col("style") == "H2", 1).otherwise(0)).over(by)
    rows = paragraphs.withColumns({"chapter": last("H1"), "question": last("H2"), "number": n})
    rows = rows.withColumn("field", F.last(F.when(F.col("style") == "H3", F.col("text")).when(F.col("style") == "H2", F.lit("")), True).over(by))
    body = rows.where((F.col("style") == "") & (F.col("number") > 0) & (F.coalesce("field", F.lit("")) != ""))
    text = body.groupBy("file", "chapter", "number", "question", "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return text.groupBy("file", "chapter", "number", "question").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "text")))).alias("fields"))


def concurrency(events: DataFrame, start: int, most: int, window: int) -> DataFrame:
    """Allowed parallel requests after each event (job_id, at, outcome) of a job: halved when throttled, one more after
    `window` successes in a row. One job's events are one ordered group."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, level, run = None, start, 0
        for part in parts:
            levels = []
            for j, outcome in zip(part["job_id"], part["outcome"], strict=True):
                if j != job:
                    job, level, run = j, start, 0
                if outcome == "throttled":
                    level, run = max(1, level // 2), 0
                else:
                    run += 1
                    if run >= window:
                        level, run = min(most, level + 1), 0
                levels.append(level)
            yield part[["job_id", "at"]].assign(level=levels)

    return events.select("job_id", "at", "outcome").repartition("job_id").sortWithinPartitions("job_id", "at").mapInPandas(fold, "job_id long, at long, level int")


def official(tags: Column, catalog: Column, key) -> tuple[Column, Column]:
    """A model's tags as (official, candidate): those whose key the catalog has, and the others."""
    known = F.transform(catalog, key)
    return F.filter(tags, lambda t: F.array_contains(known, key(t))), F.filter(tags, lambda t: ~F.array_contains(known, key(t)))


def remapped_pages(rows: DataFrame, page_map: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Evidence (source_path, pdf_page, printed_page) with the printed pages of a new map; `touched` rows need review."""
    items = rows.select("id", F.posexplode(evidence).alias("at", "e")).select("id", "at", "e.source_path", "e.pdf_page", F.col("e.printed_page").alias("before"))
    found = items.join(page_map.select("source_path", "pdf_page", "printed_page"), ["source_path", "pdf_page"], "left")
    found = found.withColumn("after", F.coalesce("printed_page", "before"))
    lists = found.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "source_path", "pdf_page", F.col("after").alias("printed_page")))), lambda x: F.struct(x["source_path"].alias("source_path"), x["pdf_page"].alias("pdf_page"), x["printed_page"].alias("printed_page"))).alias(evidence), F.max((~F.col("after").eqNullSafe(F.col("before"))).cast("int")).alias("t"))
    return rows.drop(evidence).join(lists, "id", "left").withColumn("touched", F.coalesce(F.col("t") == 1, F.lit(False))).drop("t")


def by_lines(texts: DataFrame, most: int = 8000) -> DataFrame:
    """Texts (id, text) as pieces of whole lines of at most `most` characters; a longer line is cut."""
    line = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n")))
    parts = F.flatten(F.transform(line, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.char_length(x) - 1) / most)).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most)))))
    # the fold carries numbers alone: where pieces begin, and the length of the last
    first = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(most + 1).alias("size"))
    sized = F.transform("_parts", lambda x, i: F.struct(i.alias("i"), F.char_length(x).alias("n")))
    fold = F.aggregate(sized, first, lambda acc, x: F.when(acc["size"] + x["n"] <= most, F.struct(acc["starts"].alias("starts"), (acc["size"] + x["n"]).alias("size"))).otherwise(F.struct(F.concat(acc["starts"], F.array(x["i"])).alias("starts"), x["n"].alias("size"))))
    texts = texts.select("id", parts.alias("_parts")).withColumn("_starts", fold["starts"])
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.lit(0), F.size("_starts") - 1)), F.array(F.size("_parts")))
    grown = F.zip_with("_starts", ends, lambda x, y: F.array_join(F.slice(F.col("_parts"), x + 1, y - x), ""))
    return texts.select("id", F.posexplode(grown).alias("at", "piece"))


def organised(blocks: DataFrame, parse, model) -> DataFrame:
    """Blocks parsed by rule, and only those that fail by a model; `by` says which. parse: blocks -> blocks with `issue`."""
    done = parse(blocks)
    good, bad = done.where("issue = ''"), done.where("issue <> ''")
    return good.withColumn("by", F.lit("rule")).unionByName(model(bad).withColumn("by", F.lit("model")))

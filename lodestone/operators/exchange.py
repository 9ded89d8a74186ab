"""Exchange documents: question envelopes of one bank, incremental patches, reports, and the parts they are made of.

Schemas' names are the caller's; versions and field names are those of the format. Envelopes hold a bounded number of
questions each, so no bank must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import limited_list, one_line
from ..sources.versions import export_together

BANKS = ("school", "kaoyan")
MOST, LARGEST = 5_000, 1 << 26


def meta(m: Column) -> Column:
    """An explanation's meta (mode, model, evidence_grade, reasoning_type, thinking, model_fallback, complexity,
    route_reasons, request_count, score, generated_at, reviewed_at, warnings), tidy: unknown grades and types are blank,
    a grade is told from the mode, counts are held to 0..20, texts are one line and cut."""
    line = lambda name, n: F.coalesce(one_line(m[name], n), F.lit(""))
    count = lambda name: F.greatest(F.lit(0), F.least(F.lit(20), F.coalesce(m[name], F.lit(0)))).cast("int")
    mode = line("mode", 40)
    told = F.when(mode == "general_knowledge", "C").when(mode == "textbook_reasoning", "B").when(mode == "textbook", "A").otherwise("")
    grade = F.upper(F.coalesce(F.nullif(line("evidence_grade", 1), F.lit("")), told))
    kind = line("reasoning_type", 24)
    flag = lambda name: F.coalesce(m[name], F.lit(False))
    return F.struct(
        mode.alias("mode"), line("model", 80).alias("model"), F.when(grade.isin("A", "B", "C"), grade).otherwise("").alias("evidenceGrade"),
        F.when(kind.isin("direct_answer", "case_chain"), kind).otherwise("").alias("reasoningType"), flag("thinking").alias("thinking"), flag("model_fallback").alias("modelFallback"),
        count("complexity").alias("complexityScore"), limited_list(m["route_reasons"], 12, 80).alias("routeReasons"), count("request_count").alias("requestCount"),
        F.coalesce(m["score"], F.lit(0.0)).alias("score"), line("generated_at", 40).alias("generatedAt"), line("reviewed_at", 40).alias("reviewedAt"), limited_list(m["warnings"], 10, 200).alias("reviewWarnings"),
    )


def catalog_entries(tags: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows (subject, label, aliases, status, usage, merged_into) as entries; those without subject or label go, and
    the columns `keep` stay."""
    status = F.when(F.col("status").isin("active", "candidate", "merged"), F.col("status")).otherwise("active")
    rows = tags.select(
        *keep, F.coalesce(one_line(F.col("subject"), 60), F.lit("")).alias("subject"), F.coalesce(one_line(F.col("label"), 24), F.lit("")).alias("label"),
        F.slice(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: one_line(a, 24)), 1, 20).alias("aliases"), status.alias("status"),
        F.greatest(F.lit(0), F.coalesce("usage", F.lit(0))).cast("long").alias("usageCount"), F.coalesce(one_line(F.col("merged_into"), 24), F.lit("")).alias("mergedInto"),
    )
    return rows.where("subject <> '' AND label <> ''")


def envelopes(questions: DataFrame, schema: str, name: str, source: str, exported_at: str, tags: DataFrame | None = None, version: int = 2, order: str = "id", most: int = MOST) -> DataFrame:
    """(bank, part, n_questions, document): the JSON envelopes of each bank's questions, in order.

    A bank of `most` questions or fewer, and at most LARGEST bytes, has one; a larger one is dealt by hash into parts of
    about so many, so no bank's rows meet in one task and no document is larger than a cell can be. Every column of questions is a field; null ones are left out. The tags' entries, a catalog's
    size, go into each bank's first part. A null bank is a bank of its own; an empty table has no envelope.
    """
    size = F.coalesce(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in questions.columns)))), F.lit(0)).cast("long")
    counts = questions.groupBy("bank").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(size) / LARGEST)).cast("int").alias("_parts")).withColumnRenamed("bank", "_bank")
    rows = questions.join(counts, F.col("bank").eqNullSafe(F.col("_bank"))).withColumn("_part", F.pmod(F.xxhash64(order), F.col("_parts")).cast("int"))
    fields = questions.columns
    groups = rows.groupBy("bank", "_part").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("q")))), lambda x: x["q"]).alias("questions"))
    title = one_line(F.coalesce(F.nullif(F.lit(name), F.lit("")), F.concat(F.col("bank"), F.lit("-questions"))), 120)
    about = F.struct(title.alias("name"), one_line(F.col("bank"), 20).alias("bank"), F.lit(source[:40]).alias("source"), F.lit(exported_at).alias("exportedAt"), F.size("questions").alias("questionCount"))
    kind = "array<struct<subject:string,label:string,aliases:array<string>,status:string,usageCount:bigint,mergedInto:string>>"
    if tags is not None:
        listed = catalog_entries(tags).agg(F.sort_array(F.collect_list(F.struct("subject", "label", "aliases", "status", "usageCount", "mergedInto"))).alias("x")).scalar()
        catalog = F.when(F.col("_part") == 0, listed).otherwise(F.array().cast(kind))
    else:
        catalog = F.array().cast(kind)
    body = F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(version).alias("schemaVersion"), about.alias("meta"), catalog.alias("tagCatalog"), F.col("questions")))
    return groups.select("bank", F.col("_part").alias("part"), F.size("questions").alias("n_questions"), body.alias("document"))


def is_envelope(document: Column, schema: str, version: int = 2) -> Column:
    """Whether a JSON text is such an envelope, with a list of questions."""
    found = F.from_json(document, "schema string, schemaVersion int, questions string")
    return F.coalesce((found["schema"] == schema) & (found["schemaVersion"] == version) & F.ltrim(found["questions"]).startswith("["), F.lit(False))


def patched(current: DataFrame, outcomes: DataFrame, key: str, name: str = "patch") -> DataFrame:
    """Rows to send: those of outcome `patch`, with `extensions` (a map) holding the patch under `name`: its version, its
    fields and their values before, as JSON. outcomes: see delta.preflight()."""
    told = outcomes.where("outcome = 'patch'").select(key, F.to_json(F.struct(F.lit(1).alias("version"), F.col("fields"), F.map_from_arrays(F.transform("base_values", lambda v: v["field"]), F.transform("base_values", lambda v: v["value"])).alias("baseValues"))).alias("_patch"))
    rows = current.join(told, key)
    before = F.col("extensions") if "extensions" in current.columns else F.create_map().cast("map<string,string>")
    before = F.map_filter(F.coalesce(before, F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    return rows.withColumn("extensions", F.map_concat(before, F.create_map(F.lit(name), F.col("_patch")))).drop("_patch")


def delta_report(outcomes: DataFrame, pending: int) -> DataFrame:
    """One row: ready (patches), unchanged, pending and issues, and how many issues each reason has."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    reasons = outcomes.where("outcome = 'issue'").groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return outcomes.agg(n("patch").alias("ready"), n("unchanged").alias("unchanged"), n("issue").alias("issues")).select("ready", "unchanged", F.lit(pending).cast("long").alias("pending"), "issues", F.coalesce(reasons.scalar(), F.create_map().cast("map<string,bigint>")).alias("reasons"))


def question_export(questions: DataFrame, path: str, name: str, schema: str, title: str, source: str, exported_at: str, tags: DataFrame | None = None, extra: dict[str, DataFrame] | None = None) -> dict:
    """Writes the envelopes of questions (id, bank, ...) and the mapping of their ids, as one export (see export_together).

    mapping: external_id (that of the rows, else their id as text), id, bank. A table without rows is refused.
    """
    external = F.col("external_id") if "external_id" in questions.columns else F.col("id").cast("string")
    documents = envelopes(questions, schema, title, source, exported_at, tags).select("document")
    mapping = questions.select(external.alias("external_id"), "id", "bank")
    return export_together({"documents": documents, "mapping": mapping, **(extra or {})}, path, name, {"schema": schema, "exportedAt": exported_at})


def export_selected(questions: DataFrame, chosen: DataFrame, path: str, name: str, schema: str, title: str, source: str, exported_at: str) -> dict:
    """Exports the questions whose ids are in chosen (id), each once, with chosen ids that no question has in `unknown`.

    Null and repeated ids of chosen count for nothing; if no question is left, the export is refused.
    """
    ids = chosen.where("id IS NOT NULL").select("id").distinct()
    unknown = ids.join(questions.select("id"), "id", "left_anti")
    return question_export(questions.join(ids, "id", "left_semi"), path, name, schema, title, source, exported_at, extra={"unknown": unknown})


def delta_export(current: DataFrame, outcomes: DataFrame, pending: int, key: str, path: str, name: str, schema: str, exported_at: str) -> dict:
    """Writes the report of an incremental export, its patches and its issues, as one export. See delta.preflight()."""
    patches = patched(current, outcomes, key)
    issues = outcomes.where("outcome = 'issue'").select(key, "reason")
    return export_together({"report": delta_report(outcomes, pending), "patches": patches, "issues": issues}, path, name, {"schema": schema, "exportedAt": exported_at})

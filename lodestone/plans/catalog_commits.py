"""The catalogue: versions, written exports, shut gates, canonical forms, strict answers, attempts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, schemas
from ..operators import attempts, exchange, review
from ..sources import versions
from ..sources.readers import tables
from ..store import dealt, shared
from .catalog import long, query
from .catalog_exchange import PATCHED, SCHEMA, exchanged, outcomes


def folder(spark: SparkSession, kind: str) -> str:
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


# --- versions and exports ---------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, lang, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents)
SELECT 1 AS version, doc_id, n_chars FROM d UNION ALL SELECT 2, doc_id, CASE WHEN lang = 'de' THEN -n_chars ELSE n_chars END FROM d WHERE lang IS DISTINCT FROM 'de' OR n_chars >= 500 UNION ALL SELECT 3, doc_id, n_chars FROM d""")
def versioned_publish(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, then those of one language replaced, without the short ones, then the first version restored; a
    commit that started from an old version, or from a source that differs by now, leaves nothing."""
    path = folder(spark, "table")
    rows = tables(spark, sf, "documents")[0].select("doc_id", "lang", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    versions.commit(rows, path, "doc_id")
    one = rows.where("lang = 'de'")
    versions.commit(one.where("n_chars >= 500").withColumn("n_chars", -F.col("n_chars")), path, "doc_id", keys=one.select("doc_id"), base=1)
    for stale in ({"base": 1}, {"source": one.select("doc_id"), "source_now": lambda: rows.select("doc_id")}):
        try:
            versions.commit(one, path, "doc_id", **stale)
            raise AssertionError("a stale commit went through")
        except versions.Refused:
            pass
    versions.restored(spark, path, 1)
    shown = [versions.as_of(spark, path, v).select(F.lit(v).alias("version"), "doc_id", "n_chars") for v in (1, 2, 3)]
    return shown[0].union(shown[1]).union(shown[2])


@query("""SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'kaoyan' ELSE 'school' END AS bank, md5(coalesce(text, '')) AS question_md5, CAST(item_id AS VARCHAR) AS external_id FROM benchmark""")
def export_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written with the mapping of their ids and read back from both files."""
    path = folder(spark, "exports")
    exchange.question_export(exchanged(spark, sf), path, "first", SCHEMA, "", "test", "2026-01-01T00:00:00Z")
    told = F.from_json("document", "questions array<struct<id:bigint,bank:string,question:string>>")
    rows = versions.exported(spark, path, "first", "documents").select(F.inline(told["questions"]))
    mapping = versions.exported(spark, path, "first", "mapping", "external_id string, id long, bank string")
    return rows.join(mapping, ["id", "bank"]).select("id", "bank", F.md5(F.coalesce("question", F.lit(""))).alias("question_md5"), "external_id")


@query("""WITH c AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id AS id, md5(coalesce(text, '')) AS question_md5, (SELECT count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_unknown FROM documents WHERE doc_id IN (SELECT doc_id FROM c)""")
def selected_export(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that are labelled toxic, exported by their ids, read back."""
    path = folder(spark, "exports")
    docs, labels = tables(spark, sf, "documents", "labels")
    rows = docs.select(F.col("doc_id").alias("id"), F.lit("school").alias("bank"), F.col("text").alias("question"))
    exchange.export_selected(rows, labels.where("toxic = 1").select(F.col("doc_id").alias("id")), path, "picked", SCHEMA, "picked", "test", "2026-01-01T00:00:00Z")
    unknown = versions.export_history(spark, path).select(F.get_json_object("about", "$.counts.unknown").cast("long").alias("n_unknown"))
    told = F.from_json("document", "questions array<struct<id:bigint,question:string>>")
    found = versions.exported(spark, path, "picked", "documents").select(F.inline(told["questions"]))
    return found.select("id", F.md5(F.coalesce("question", F.lit(""))).alias("question_md5")).crossJoin(F.broadcast(unknown))  # one row


@query("WITH " + PATCHED + """, n AS (SELECT count_if(reason = '' AND (s OR p)) AS ready, count_if(reason <> '') AS issues FROM r) SELECT o_orderkey, reason, CASE WHEN reason = '' THEN concat_ws(',', CASE WHEN s THEN 'o_orderstatus' END, CASE WHEN p THEN 'o_orderpriority' END) END AS fields, CAST(ready AS BIGINT) AS n_ready, CAST(issues AS BIGINT) AS n_issues FROM r, n WHERE reason <> '' OR s OR p""")
def delta_export(spark: SparkSession, sf: str) -> DataFrame:
    """Patches, issues and report of an incremental export, written together and read back."""
    path = folder(spark, "exports")
    now, found = outcomes(spark, sf)
    exchange.delta_export(now.drop("errors"), found, 0, "o_orderkey", path, "delta", SCHEMA, "2026-01-01T00:00:00Z")
    patch = F.from_json(F.get_json_object("extensions", "$.patch"), "fields array<string>")
    sent = versions.exported(spark, path, "delta", "patches", "o_orderkey long, extensions string").select("o_orderkey", F.lit("").alias("reason"), F.array_join(patch["fields"], ",").alias("fields"))
    wrong = versions.exported(spark, path, "delta", "issues", "o_orderkey long, reason string").withColumn("fields", F.lit(None).cast("string"))
    report = versions.exported(spark, path, "delta", "report", "ready long, issues long").select(F.col("ready").alias("n_ready"), F.col("issues").alias("n_issues"))
    return sent.union(wrong).crossJoin(F.broadcast(report))  # one row


# --- gates ------------------------------------------------------------------------------------------------------------

#: what is changed in a good row, and what quick review, unattended approval and package validation then say
SPOILT = [
    ("good", "", "", ""), ("evidence", "no evidence", "quick review", "evidence"), ("tags", "no tags", "quick review", "tags"), ("pipeline_status", "state", "quick review", ""), ("generation_mode", "mode", "quick review", ""), ("quote", "weak evidence", "quick review", ""),
    ("score", "weak evidence", "quick review", ""), ("section", "unknown block", "quick review", "sections"), ("explanation", "short", "quick review", ""), ("warnings", "", "", ""), ("suggested", "", "", ""), ("blocks", "no blocks", "quick review", "sections,table"), ("grade", "", "grade not stated", ""),
    ("bank", "", "unknown bank", ""), ("errors", "", "broken rules", ""), ("manual", "", "manual", ""), ("brief", "no brief", "quick review", "brief"), ("match_score", "score", "quick review", ""),
]


@query("SELECT item_id, v.* FROM benchmark, (VALUES " + ", ".join(map(str, SPOILT)) + ") AS v(spoilt, quick, auto, problems)")
def review_gate_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A good row for each text, and the same with one field null: no gate lets through what it cannot judge."""
    rows = tables(spark, sf, "benchmark")[0].select("item_id", "text", F.explode(F.array(*(F.lit(x[0]) for x in SPOILT))).alias("spoilt"))
    good = lambda name, c: F.when(F.col("spoilt") != name, c).alias(name)
    keep = lambda name, c: F.when(F.col("spoilt") != name, F.lit(c))
    block = lambda s, t: F.struct(s.alias("section"), F.lit(t).alias("type"))
    blocks = F.array(block(keep("section", "analysis"), "paragraph"), block(F.lit("answerBasis"), "list"), block(F.lit("pitfalls"), "table"))
    text = F.coalesce("text", F.lit(""))
    proof = F.array(F.struct(F.lit("book").alias("book"), F.lit(3).alias("printed_page"), F.when(F.col("spoilt") != "quote", F.concat(text, F.lit("q" * 20))).alias("quote"), keep("score", 0.9).alias("score")))
    none = F.array().cast("array<string>")
    package = rows.select(
        "item_id", "spoilt", good("pipeline_status", F.lit("generated")), F.lit("pending").alias("review_status"), good("generation_mode", F.lit("textbook")), F.lit("").alias("error_message"), good("match_score", F.lit(0.9)),
        F.when(F.col("spoilt") == "explanation", F.lit(" " * 90)).otherwise(F.concat(text, F.lit("e" * 80))).alias("explanation"), good("grade", F.lit("A")), good("warnings", none), good("blocks", blocks), good("tags", F.when(F.col("spoilt") == "suggested", F.array(F.lit("t"))).otherwise(none)),
        F.when(~F.col("spoilt").isin("tags", "suggested"), F.array(F.lit("s"))).alias("suggested"), good("brief", F.lit("brief")), good("evidence", proof), good("errors", none), good("bank", F.lit("school")), good("manual", F.lit(False)), F.lit("A1").alias("type"), F.lit("b").alias("answer"), F.lit(4).alias("n_options"),
    )
    quick = review.quick_reason(0.75)
    return package.select("item_id", "spoilt", quick.alias("quick"), review.auto_reason(quick).alias("auto"), F.array_join(review.package_problems(), ",").alias("problems"))


# --- canonical forms and strict answers -------------------------------------------------------------------------------

ASCII = "".join(map(chr, range(0x21, 0x7F)))
WIDE = "".join(chr(ord(x) + 0xFEE0) for x in ASCII)


@query(r"""WITH t AS (SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS x FROM benchmark WHERE text IS NOT NULL) SELECT item_id, sha256('{"a": [' || to_json(x) || ', {"k": "ff", "n": 1.5}], "q": ' || to_json(x) || '}') AS fingerprint, true AS same FROM t""")
def canonical_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of nested values made of each text, and of the same in wide letters, other order and spacing."""
    rows = tables(spark, sf, "benchmark")[0].where("text IS NOT NULL")
    # lists of texts and objects have no type of Spark's: the list's members are written in as JSON
    inner = lambda text, object_: F.concat(F.lit('{"sourceBlock": 4, "q": '), F.to_json(text.cast("variant")), F.lit(', "a": ['), F.to_json(text.cast("variant")), F.lit(f", {object_}]}}"))
    wide = F.concat(F.lit("　 "), F.regexp_replace(F.translate("text", ASCII, WIDE), r"\s", "　\n"))
    a = canonical.json_fingerprint(inner(F.col("text"), '{"n": 1.5, "k": "ff"}'), ("sourceBlock",))
    b = canonical.json_fingerprint(inner(wide, '{"k": "ﬀ", "n": 1.5}'), ("sourceBlock",))
    return rows.select("item_id", a.alias("fingerprint"), (a == b).alias("same"))


FAULTY = [("", "{}"), ("$: not JSON", "{"), ("$.more: unknown field", '{"more": 1}'), ("$.explanationBlocks: too few", '{"explanationBlocks": []}'), ("$.tags: too many", '{"tags": ["a", "b", "c", "d"]}'), ("$.tags[1]: not text", '{"tags": ["a", 2]}'), ("$.explanationBlocks[0].type: not one of the values", '{"explanationBlocks": [{"section": "analysis", "type": "prose"}]}'), ("$.evidenceContext.evidenceId: missing", '{"evidenceContext": {"excerpt": "x"}}')]


@query("WITH f AS (SELECT unnest(generate_series(0, 7)) AS i, unnest([" + ", ".join(f"'{x}'" for x, _ in FAULTY) + """]) AS fault), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, i, CASE WHEN i = 1 THEN fault WHEN length(t) > 200 AND i NOT IN (1, 2, 3, 6) THEN '$.briefExplanation: too long' ELSE fault END AS fault, CASE WHEN i = 0 AND length(t) <= 200 THEN md5(t) END AS brief_md5 FROM d, f""")
def strict_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each text as a package's short explanation, good and with one thing wrong: the first fault of each, none fails the job."""
    good = json.dumps({"explanationBlocks": [{"section": "pitfalls", "type": "table", "rows": [["a"]]}]})
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("changed")) for i, (_, x) in enumerate(FAULTY)))
    rows = tables(spark, sf, "documents")[0].select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.inline(kinds))
    head = lambda x: F.regexp_replace(x, r"\}$", "")
    own = F.when(F.col("changed").contains("explanationBlocks"), F.lit("")).otherwise(F.lit(good[1:-1] + ", "))
    changed = F.concat(F.lit("{"), own, F.lit('"briefExplanation": '), F.to_json(F.col("text").cast("variant")), F.when(F.col("changed") == "{}", F.lit("")).otherwise(F.concat(F.lit(", "), F.substring(head(F.col("changed")), 2, 1 << 20))), F.lit("}"))
    answers = rows.withColumn("answer", F.when(F.col("changed") == "{", F.col("changed")).otherwise(changed))
    found = schemas.checked(answers, "answer", schemas.PACKAGE, "briefExplanation string")
    return found.select("doc_id", long("i"), F.coalesce("fault", F.lit("")).alias("fault"), F.md5("value.briefExplanation").alias("brief_md5"))


# --- attempts ---------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 5 THEN 'failed' ELSE 'done' END AS state, CASE c_custkey % 6 WHEN 2 THEN 'provider_rate_limited' WHEN 3 THEN 'provider_fatal' WHEN 5 THEN 'schema_validation_failed' ELSE '' END AS code,
CASE WHEN c_custkey % 6 IN (0, 1, 4) THEN c_name END AS value, CAST(CASE c_custkey % 6 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN c_custkey % 6 = 4 THEN 'plain' ELSE 'first' END AS model FROM customer""")
def attempt_states(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by a schedule: some at once, some at a second try, some never, some only by the plain model."""

    def call(some: list[dict]) -> list[dict]:
        def one(r: dict) -> dict:
            kind, good = r["c_custkey"] % 6, {"value": r["c_name"]}
            return {0: good, 1: good if r["attempt"] else {"status": 503}, 2: {"status": 429}, 3: {"status": 401}, 4: good if r["model"] == "plain" else {"status": 404}, 5: {"invalid": "schema_validation_failed"}}[kind]

        return [one(r) for r in some]

    rows = tables(spark, sf, "customer")[0].select("c_custkey", "c_name", F.lit("first").alias("model"), F.lit("plain").alias("plain_model"))
    results, _ = attempts.attempted(rows, "c_custkey", call, pause=lambda seconds: None)
    return results.select("c_custkey", "state", "code", "value", long("attempts"), "model")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents), m AS (SELECT doc_id, w, w[1:doc_id % 5] AS s FROM d), o AS (SELECT *, CASE WHEN len(s) BETWEEN 1 AND 3 THEN 'model' WHEN doc_id % 2 = 0 AND len(w) > 0 THEN 'repaired' ELSE 'rule' END AS origin FROM m)
SELECT doc_id, origin, array_to_string(CASE origin WHEN 'model' THEN s WHEN 'repaired' THEN w[1:3] ELSE ['none'] END, ',') AS subjects, CASE WHEN origin = 'model' THEN '' WHEN len(s) > 3 AND (origin = 'repaired') THEN '$.subjects: too many' WHEN origin = 'repaired' THEN 'no subject' WHEN doc_id % 2 = 0 THEN 'no subject' ELSE '$: not JSON' END AS fault FROM o""")
def repaired_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Answers made of each text's words: too many or none are repaired where the repair works, else made by rule."""

    def first(some: list[dict]) -> list[str]:
        return [json.dumps({"subjects": re.findall("[A-Za-z]+", r["text"])[: r["doc_id"] % 5]}) for r in some]

    def again(some: list[dict]) -> list[str]:
        return ["{" if r["doc_id"] % 2 else json.dumps({"subjects": re.findall("[A-Za-z]+", r["text"])[:3]}) for r in some]

    rows = tables(spark, sf, "documents")[0].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = attempts.packaged(rows, first, again, F.lit('{"subjects": ["none"]}'), schemas.SUBJECTS, "subjects array<string>", F.when(F.size("value.subjects") == 0, "no subject"))
    return made.select("doc_id", "origin", F.array_join("value.subjects", ",").alias("subjects"), F.coalesce("fault", F.lit("")).alias("fault"))


RANKED = """n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem)"""


@query("WITH " + RANKED + """ SELECT k AS query_id, CASE WHEN k % 5 = 1 THEN 'index' WHEN k % 5 = 2 AND n > 1 THEN 'repeated' WHEN k % 5 = 3 THEN 'score' WHEN k % 5 = 4 THEN 'missing' ELSE '' END AS fault FROM n""")
def ranking_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a reranker's results for their orders, wrong in a way that depends on the order."""
    lines = dealt(tables(spark, sf, "lineitem")[0].select("l_orderkey", "l_linenumber", "l_discount"), "l_orderkey")
    k, i = F.col("query_id"), F.col("i")
    placed = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_discount").cast("double").alias("score"), (F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)") - 1).alias("i"))
    found = placed.where(~((k % 5 == 4) & (i == 0))).select("query_id", F.when((k % 5 == 1) & (i == 0), -1).when(k % 5 == 2, 0).otherwise(i).alias("index"), F.when((k % 5 == 3) & (i == 0), float("inf")).otherwise(F.col("score")).alias("score"))
    return attempts.rank_faults(found, lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count("*").alias("n")))

"""The catalogue's last part: clean-up of nested fields, edits, audits, selections and regrouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaners, scoring
from ..functions.text import key
from ..operators import audits, browse, edits, questions, review, status
from ..sources.readers import tables
from .catalog import long, query
from .catalog_more import BANK, REASON, bank, packages

NOW = "1996-01-01"


def states(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    return bank(spark, sf).withColumns({"n_evidence": (i % 4).cast("int"), "n_blocks": (i % 5).cast("int"), "error_message": F.when(i % 4 == 0, "score below threshold").otherwise("parse failed"), "match_confidence": F.lit("low"), "explanation": F.when(i % 6 == 0, "TODO write").otherwise(F.substring("prompt_text", 1, 60)), "warnings": F.when(i % 9 == 0, F.array(F.lit("no table"))).otherwise(F.array().cast("array<string>")), "viewed_at": F.when(i % 2 == 0, F.lit(NOW).cast("timestamp_ntz"))})


STATES = BANK + """, states AS (SELECT *, id % 4 AS n_evidence, id % 5 AS n_blocks, CASE WHEN id % 4 = 0 THEN 'score below threshold' ELSE 'parse failed' END AS error_message, CASE WHEN id % 6 = 0 THEN 'TODO write' ELSE substr(prompt_text, 1, 60) END AS explanation FROM bank)"""


@query("WITH " + STATES + " SELECT id FROM states WHERE review_status = 'pending' AND retrieval_status = 'matched' AND generation_status IN ('validation_error', 'provider_error') AND n_evidence > 0")
def matched_failures(spark: SparkSession, sf: str) -> DataFrame:
    return audits.failures(states(spark, sf)).select("id")


@query("WITH " + STATES + " SELECT id FROM states WHERE review_status = 'pending' AND pipeline_status IN ('unmatched', 'no_library')")
def general_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return audits.general(states(spark, sf)).select("id")


@query("WITH " + STATES + " SELECT id FROM states WHERE review_status = 'pending' AND pipeline_status IN ('unmatched', 'error') AND (contains(error_message, 'parse') OR id % 9 = 0)")
def abnormal_generation(spark: SparkSession, sf: str) -> DataFrame:
    return audits.abnormal(states(spark, sf), ["parse", "no table"]).select("id")


@query("WITH " + STATES + " SELECT id FROM states WHERE pipeline_status = 'generated' AND (id % 4 = 0 OR id % 7 = 0)")
def missing_points(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    point = F.struct(F.when(i % 4 == 0, " ").otherwise("t").alias("title"), F.lit("b").alias("body"))
    rows = states(spark, sf).withColumn("points", F.when(i % 7 != 0, F.array(point)))
    return audits.lacking(rows, "points", "title", "body").select("id")


@query("WITH " + STATES + " SELECT id, CASE WHEN id % 8 = 0 THEN 'queued' ELSE pipeline_status END AS pipeline_status, CASE WHEN id % 8 = 0 THEN 'pending' ELSE retrieval_status END AS retrieval_status, CASE WHEN id % 8 = 0 THEN 'pending' ELSE review_status END AS review_status, CASE WHEN id % 8 = 0 THEN 'law' ELSE subject END AS subject FROM states")
def subject_change(spark: SparkSession, sf: str) -> DataFrame:
    done = edits.subject_changed(states(spark, sf), F.col("id") % 8 == 0, "law", bulk=True)
    return done.select("id", "pipeline_status", "retrieval_status", "review_status", "subject")


@query("WITH " + STATES + ", x AS (SELECT *, id % 2 = 0 AND retrieval_status = 'matched' AND n_evidence > 0 AS h FROM states) SELECT id, CASE WHEN h THEN 'queued' ELSE pipeline_status END AS pipeline_status, retrieval_status, CASE WHEN h THEN 'pending' ELSE generation_status END AS generation_status FROM x")
def requeue_matched(spark: SparkSession, sf: str) -> DataFrame:
    return edits.queued(states(spark, sf), F.col("id") % 2 == 0, keep_retrieval=True).select("id", "pipeline_status", "retrieval_status", "generation_status")


@query("WITH " + STATES + ", x AS (SELECT *, pipeline_status = 'unmatched' AND match_score >= 0.6 AND n_evidence > 0 AND NOT contains(error_message, 'below') AS h FROM states) SELECT id, CASE WHEN h THEN 'error' ELSE pipeline_status END AS pipeline_status, CASE WHEN h THEN 'validation_error' ELSE generation_status END AS generation_status, CASE WHEN h THEN CASE WHEN match_score >= 0.7 THEN 'strong' ELSE 'standard' END ELSE 'low' END AS match_confidence FROM x")
def reconcile_high_scores(spark: SparkSession, sf: str) -> DataFrame:
    sure = scoring.stored_confidence(F.col("match_score"), F.array().cast("array<double>"))
    return edits.reconciled(states(spark, sf), 0.6, "below", sure).select("id", "pipeline_status", "generation_status", "match_confidence")


@query("WITH " + STATES + ", x AS (SELECT *, explanation LIKE 'TODO%' AS h FROM states), y AS (SELECT *, pipeline_status = 'generated' AND (trim(explanation) = '' OR h OR trim(explanation) LIKE '{%' OR n_blocks = 0 OR (generation_mode <> 'general_knowledge' AND n_evidence = 0)) AS bad FROM x) SELECT id, CASE WHEN bad THEN 'error' ELSE pipeline_status END AS pipeline_status, md5(CASE WHEN bad AND h THEN '' ELSE explanation END) AS text_md5 FROM y")
def reclassify_unusable(spark: SparkSession, sf: str) -> DataFrame:
    return edits.unusable(states(spark, sf), ["TODO"]).select("id", "pipeline_status", F.md5("explanation").alias("text_md5"))


@query("WITH " + STATES + " SELECT id, CASE WHEN id % 5 = 0 AND id % 2 = 0 AND trim(explanation) <> '' THEN 'approved' WHEN id % 5 = 1 THEN 'rejected' ELSE review_status END AS review_status FROM states")
def review_actions(spark: SparkSession, sf: str) -> DataFrame:
    rows = states(spark, sf)
    acts = rows.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "approved").otherwise("rejected").alias("action"), F.lit("n").alias("note"))
    return edits.reviewed(rows, acts)[0].select("id", "review_status")


@query("WITH " + STATES + f" SELECT id, CASE WHEN id % 2 = 0 THEN TIMESTAMP '{NOW}' WHEN id % 3 = 0 THEN TIMESTAMP '1997-01-01' END AS viewed_at FROM states")
def first_seen_once(spark: SparkSession, sf: str) -> DataFrame:
    return edits.first_seen(states(spark, sf), F.col("id") % 3 == 0, F.lit("1997-01-01").cast("timestamp_ntz")).select("id", "viewed_at")


@query("SELECT p_partkey, 'one|' || p_name || '|two' AS points, CASE WHEN p_partkey % 2 = 0 THEN 'too many' ELSE '' END AS problem FROM part WHERE length(p_name) BETWEEN 4 AND 60 AND NOT contains(p_name, ',')")
def knowledge_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "part")[0].where("char_length(p_name) BETWEEN 4 AND 60 AND NOT contains(p_name, ',')")
    points, problem = edits.knowledge_points(F.concat(F.lit("one; x;"), "p_name", F.lit(", two,ONE"), F.when(F.col("p_partkey") % 2 == 0, "、three").otherwise("")))
    return rows.select("p_partkey", F.array_join(points, "|").alias("points"), problem.alias("problem"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a=1' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ',' ELSE '' END || 'k=' || p_brand AS entries FROM part")
def extension_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "part")[0].withColumn("extensions", F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("k"), F.lit("old"), F.lit("a"), F.lit("1"))))
    done = edits.extended(rows, "k", F.col("p_brand"))
    entries = F.sort_array(F.transform(F.map_entries("extensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return done.select("p_partkey", F.array_join(entries, ",").alias("entries"))


@query("SELECT source AS source_file, count(DISTINCT lang) AS page_count, count(*) AS n_chunks FROM documents GROUP BY source")
def legacy_copy(spark: SparkSession, sf: str) -> DataFrame:
    d = tables(spark, sf, "documents")[0]
    old = d.select(F.col("source").alias("source_file"), F.col("lang").alias("source_page"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("chunk_text"), F.lit(None).cast("array<float>").alias("embedding"))
    return edits.migrated(old)[0]


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0)")
def compatible_files(spark: SparkSession, sf: str) -> DataFrame:
    s, n = tables(spark, sf, "supplier", "nation")
    k = F.col("s_suppkey")
    files = s.select("s_suppkey", F.col("s_nationkey").alias("library_id"), F.when(k % 3 == 0, "missing").otherwise("ready").alias("status"), F.when(k % 5 == 0, "f").otherwise("g").alias("index_fingerprint"), F.create_map(F.lit("model"), F.when(k % 7 == 0, "m").otherwise("x")).alias("index_profile"))
    libraries = n.select(F.col("n_nationkey").alias("library_id"), F.lit("s").alias("subject"), (F.col("n_nationkey") % 2 == 0).alias("active"))
    return audits.compatible(files, libraries, "s", "f", {"model": "m"}).select("s_suppkey")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 ORDER BY label, vec_id LIMIT 10")
def pending_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf, "embeddings")[0]
    rows = e.select("vec_id", F.col("label").alias("page_number"), F.col("vec_id").alias("chunk_index"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return audits.pending_batch(rows, 10).select("vec_id")


@query("SELECT doc_id, CAST(doc_id % 90 + 1 AS BIGINT) AS printed_page FROM documents WHERE doc_id % 2 = 0")
def page_headers(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    rows = tables(spark, sf, "documents")[0].select("doc_id", F.lit(0).alias("chunk_index"), F.concat(F.when(i % 2 == 0, F.concat(F.lit(" "), (i % 90 + 1).cast("string"), F.lit("\n"))).otherwise("x\n"), F.coalesce("text", F.lit(""))).alias("chunk_text"))
    return audits.header_numbers(rows).select("doc_id", long("printed_page"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN doc_id % 5 = 1 OR (doc_id % 5 > 2 AND doc_id % 40 = 0) THEN 'invalid page' WHEN doc_id % 5 = 2 THEN 'no file' WHEN doc_id % 40 > 30 THEN 'beyond the last page' ELSE 'ok' END AS state FROM documents""")
def citation_audit(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    docs, n = tables(spark, sf, "documents", "nation")
    cited = docs.select("doc_id", F.when(i % 5 == 0, " ").when(i % 5 == 1, "iv").when(i % 5 == 2, "3").otherwise((i % 40).cast("string")).alias("page"), F.when(i % 5 == 2, F.lit("none")).otherwise((i % 25).cast("string")).alias("file"))
    files = n.select(F.col("n_nationkey").cast("string").alias("file"), F.lit(30).alias("page_count"))
    return audits.citation_audit(cited, files).select("doc_id", "state")


@query("SELECT event_type, CAST(count(*) * 2 AS BIGINT) AS requests, CAST(sum(event_id % 10 + 5) AS BIGINT) AS tokens FROM events GROUP BY 1")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf, "events")[0]
    step = lambda n: F.struct(n.cast("long").alias("tokens"))
    rows = e.select("event_type", F.array(step(F.col("event_id") % 10), step(F.lit(5))).alias("trace"))
    return audits.usage(rows, ["event_type"]).select("event_type", long("requests"), "tokens")


@query("WITH " + BANK + " SELECT count(*) AS total, CAST(count_if(review_status = 'approved') AS BIGINT) AS approved, CAST(ceil(count(*) / 20.0) AS BIGINT) AS batches FROM bank")
def backfill_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return audits.estimate(bank(spark, sf))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def once_per_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables(spark, sf, "documents")[0].where("text IS NOT NULL").select("doc_id", "text")
    return audits.once_per(docs, ["text"], lambda d: d.withColumn("n", F.char_length("text").cast("long"))).select("doc_id", "n")


@query("SELECT o_orderkey AS id, coalesce(parts, '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def sheet_regroup(spark: SparkSession, sf: str) -> DataFrame:
    o, items = tables(spark, sf, "orders", "lineitem")
    flat = items.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), "l_partkey", F.lit("t").alias("type"))
    made = audits.regrouped(o.select(F.col("o_orderkey").alias("id")), flat.select("id", "at", "l_partkey", "type"), flat.where("at = 1").select("id", "at", "type"))
    return made.select("id", F.coalesce(F.array_join(F.transform("blocks", lambda b: b["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


@query("SELECT source AS file, CAST(n AS BIGINT) AS number, 'a' || CAST(n AS VARCHAR) || chr(10) || 'more' AS answer FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) CROSS JOIN (SELECT unnest([1, 2]) AS n)")
def heading_fields(spark: SparkSession, sf: str) -> DataFrame:
    lines = [("H1", "c"), ("H2", "q1"), ("", "lost"), ("H3", "answer"), ("", "a1"), ("", "more"), ("H2", "q2"), ("H3", "answer"), ("", "a2"), ("", "more")]
    rows = F.array(*(F.struct(F.lit(s).alias("style"), F.lit(t).alias("text")) for s, t in lines))
    files = tables(spark, sf, "documents")[0].where("source IS NOT NULL").select(F.col("source").alias("file")).distinct()
    made = audits.from_headings(files.select("file", F.posexplode(rows).alias("at", "x")).select("file", "at", "x.*"))
    return made.select("file", long("number"), F.element_at("fields", "answer").alias("answer"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS job_id, event_id AS e, event_id % 17 = 0 AS slow, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT job_id, e, n, CASE WHEN slow THEN 4 ELSE 8 END AS level, CASE WHEN slow THEN 0 ELSE 1 END AS run FROM o WHERE n = 1
UNION ALL SELECT o.job_id, o.e, o.n, CASE WHEN slow THEN greatest(1, level // 2) WHEN run + 1 >= 4 THEN least(16, level + 1) ELSE level END, CASE WHEN slow OR run + 1 >= 4 THEN 0 ELSE run + 1 END FROM s JOIN o ON o.job_id = s.job_id AND o.n = s.n + 1)
SELECT job_id, e AS "at", CAST(level AS INTEGER) AS level FROM s""")
def adaptive_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf, "events")[0]
    rows = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 17 == 0, "throttled").otherwise("ok").alias("outcome"))
    return audits.concurrency(rows, 8, 16, 4)


@query("SELECT p_partkey, list_aggregate(list_filter(string_split(p_type, ' '), lambda t: lower(t) IN ('economy', 'promo')), 'string_agg', ',') AS known, len(list_filter(string_split(p_type, ' '), lambda t: lower(t) NOT IN ('economy', 'promo'))) AS n_other FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda t: lower(t) IN ('economy', 'promo'))) > 0")
def official_tags(spark: SparkSession, sf: str) -> DataFrame:
    good, other = audits.official(F.split("p_type", " "), F.array(F.lit("Economy"), F.lit("PROMO")), key)
    return tables(spark, sf, "part")[0].where(F.size(good) > 0).select("p_partkey", F.array_join(good, ",").alias("known"), long(F.size(other), "n_other"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 < 4 THEN CAST(doc_id % 10 + 100 AS VARCHAR) ELSE '7' END AS pages, doc_id % 10 < 4 AS touched FROM documents")
def evidence_pages(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    rows = tables(spark, sf, "documents")[0].select(i.alias("id"), F.array(F.struct(F.lit("p").alias("source_path"), (i % 10).cast("int").alias("pdf_page"), F.lit(7).alias("printed_page"))).alias("evidence"))
    found = spark.createDataFrame([("p", k, k + 100) for k in range(4)], "source_path string, pdf_page int, printed_page int")
    return audits.remapped_pages(rows, found).select("id", F.array_join(F.transform("evidence", lambda e: e["printed_page"].cast("string")), ",").alias("pages"), "touched")


@query("SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS n_chars, true AS bounded FROM documents WHERE text IS NOT NULL")
def line_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables(spark, sf, "documents")[0].where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    n = F.char_length("piece")
    return audits.by_lines(docs).groupBy(F.col("id").alias("doc_id")).agg(F.sum(n).cast("long").alias("n_chars"), (F.max(n) <= 8000).alias("bounded"))


@query("SELECT item_id, 'T=b' AS points FROM benchmark")
def study_points(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda t, b: F.struct(F.lit(t).alias("title"), F.lit(b).alias("body"))
    made = cleaners.study_points(F.array(p(" T ", "b"), p("t", "again"), p("", "x"), p("u", " ")))
    return tables(spark, sf, "benchmark")[0].select("item_id", F.array_join(F.transform(made, lambda x: F.concat(x["title"], F.lit("="), x["body"])), ";").alias("points"))


@query("SELECT item_id, 'A' AS titles FROM benchmark")
def memory_cards(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda t, b: F.struct(F.lit(t).alias("title"), F.lit(b).alias("content"), F.lit("").alias("cue"), F.lit("").alias("contrast"))
    made = cleaners.memory_cards(F.array(c("A", "one two"), c("B", "ONE-TWO"), c("C", "stem text")), F.array(F.lit("Stem  Text")))
    return tables(spark, sf, "benchmark")[0].select("item_id", F.array_join(F.transform(made, lambda x: x["title"]), ",").alias("titles"))


@query("SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN substr(trim(text), 1, 2000) ELSE 'e' END) AS quote_md5, CAST(CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id END AS INTEGER) AS page, 1.0 :: DOUBLE AS score FROM benchmark WHERE trim(text) <> ''")
def normal_evidence(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    e = F.struct(F.lit("b").alias("book"), F.when(i % 2 == 0, F.col("text")).otherwise(" ").alias("quote"), F.lit("e").alias("excerpt"), F.when(i % 3 == 0, -1).otherwise(i).cast("int").alias("page"), F.lit(1.7).alias("score"), F.array(F.lit("")).alias("highlights"))
    made = cleaners.evidence_items(F.array(e))
    one = F.element_at(made, 1)
    return tables(spark, sf, "benchmark")[0].where("trim(text) <> ''").select("item_id", F.md5(one["quote"]).alias("quote_md5"), one["page"].alias("page"), one["score"].alias("score"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'a;b' WHEN 1 THEN 'x;y' ELSE 'A. p;B. q' END AS options FROM benchmark")
def option_texts(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit('["a"," b ",""]'), F.lit("x| y|"), F.lit("A. p\n\nB. q")), (F.col("item_id") % 3 + 1).cast("int"))
    return tables(spark, sf, "benchmark")[0].select("item_id", F.array_join(cleaners.options(raw), ";").alias("options"))


@query("SELECT item_id, CAST(CASE item_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN 9 WHEN 3 THEN 21 END AS INTEGER) AS edition FROM benchmark")
def editions(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["Book 3rd edition", "x 第十版", "第九版 y", "二十一版", "none"])), (F.col("item_id") % 5 + 1).cast("int"))
    return tables(spark, sf, "benchmark")[0].select("item_id", cleaners.edition(name).alias("edition"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'heart surgery' WHEN p_partkey % 3 = 1 THEN 'heart' END AS subject, CASE WHEN p_partkey % 3 = 2 THEN 'subject unknown' WHEN p_partkey % 2 = 0 THEN 'edition unknown' ELSE '' END AS warning FROM part")
def name_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "heart surgery").when(k % 3 == 1, "the heart").otherwise("tales"), F.when(k % 2 == 0, ".pdf").otherwise(" 2e.pdf"))
    subject, warning = cleaners.inferred(name, ["heart", "heart surgery"])
    return tables(spark, sf, "part")[0].select("p_partkey", subject.alias("subject"), warning.alias("warning"))


@query(r"""SELECT c_custkey, 'a_b' || c_custkey || '.json' AS file, 'https://x.example/v1' AS address, 'failed Bearer *** with ***' AS message FROM customer""")
def safe_texts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit(' a/:b'), F.col("c_custkey").cast("string"), F.lit(".json. "))
    return tables(spark, sf, "customer")[0].select("c_custkey", cleaners.safe_name(name).alias("file"), cleaners.service_address(F.lit(" https://x.example/v1/chat/completions/ ")).alias("address"), cleaners.redacted(F.lit("failed  bearer abc.def\nwith sk-ABCDEFGH12")).alias("message"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 7.0 WHEN 1 THEN 90.0 END :: DOUBLE AS seconds FROM benchmark")
def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, [" 7 ", "Mon, 01 Jan 1996 00:01:30 GMT", "soon"])), (F.col("item_id") % 3 + 1).cast("int"))
    return tables(spark, sf, "benchmark")[0].select("item_id", cleaners.retry_after(raw, F.lit("1996-01-01 00:00:00").cast("timestamp")).alias("seconds"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '{"a": 1}' END AS found, CASE WHEN item_id % 2 = 0 THEN 'time-out' ELSE 'no {json here' END AS summary FROM benchmark""")
def salvage(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("item_id") % 2 == 0
    raw = F.when(even, 'text {"a": 1} more').otherwise("no {json here")
    message = F.when(even, "request timed out\nx").otherwise("no {json here\ny")
    return tables(spark, sf, "benchmark")[0].select("item_id", cleaners.salvaged(raw).alias("found"), cleaners.error_summary(message, {"(?i)timed? ?out": "time-out"}).alias("summary"))


@query("SELECT item_id, 'two;stem' AS focus, CAST(5 AS BIGINT) AS margin, CAST(60 AS BIGINT) AS n_pages, item_id % 2 = 0 AS ocr FROM benchmark")
def page_probes(spark: SparkSession, sf: str) -> DataFrame:
    focus = cleaners.answer_focus(F.lit("stem\nA. one\nB. two"), F.lit("b"))
    margin = cleaners.margin_numbers(F.array(*map(F.lit, [" 5 ", *["text"] * 15, "12 a", "9x"])))
    pages_ = cleaners.sampled_pages(F.lit(900))
    ocr = cleaners.needs_ocr(F.lit(False), F.when(F.col("item_id") % 2 == 0, 0.5).otherwise(0.0), F.lit(0.1), F.lit(500), F.lit(0))
    return tables(spark, sf, "benchmark")[0].select("item_id", F.array_join(focus, ";").alias("focus"), long(F.element_at(margin, 1), "margin"), long(F.size(pages_), "n_pages"), ocr.alias("ocr"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 3 ELSE 1 END :: BIGINT AS n FROM benchmark WHERE length(text) > 30")
def sub_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "benchmark")[0].where("char_length(text) > 30")
    texts = questions.sub_queries(F.concat(F.lit("Short one. A clearly longer sentence than all the others "), F.lit("x" * 300), F.lit(".")), F.lit("answer"), F.when(F.col("item_id") % 2 == 0, "A2").otherwise("A1"))
    return rows.select("item_id", long(F.size(texts), "n"))


@query("WITH " + BANK + """, x AS (SELECT *, id % 13 <> 0 AND id % 17 <> 0 AS has_table FROM bank) SELECT id, concat_ws(',', CASE WHEN id % 13 = 0 OR id % 17 = 0 THEN 'sections' END, CASE WHEN NOT has_table THEN 'table' END, CASE WHEN id % 43 = 0 THEN 'brief' END) AS problems FROM x""")
def package_validation(spark: SparkSession, sf: str) -> DataFrame:
    return packages(spark, sf).select("id", F.array_join(review.package_problems(), ",").alias("problems"))


@query("WITH " + BANK + f""", r AS (SELECT id, coalesce(grade, '') AS grade, {REASON} FROM bank) SELECT id, CASE WHEN reason <> '' THEN 'quick review' WHEN grade <> 'A' AND id % 2 = 0 THEN 'grade not stated' WHEN id % 3 = 0 AND id % 5 = 0 THEN 'unknown bank' WHEN id % 7 = 0 THEN 'answer' WHEN id % 11 = 0 THEN 'several answers' ELSE '' END AS reason FROM r""")
def auto_review_reason(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = packages(spark, sf).withColumn("quick", review.quick_reason(0.75))
    rows = rows.withColumns({"grade": F.when(i % 2 != 0, "A").otherwise(F.col("grade")), "errors": F.array().cast("array<string>"), "bank": F.when((i % 3 == 0) & (i % 5 == 0), "x").otherwise("school"), "manual": F.lit(False), "type": F.lit("A1"), "answer": F.when(i % 7 == 0, "Z").when(i % 11 == 0, "AB").otherwise("b"), "n_options": F.lit(4)})
    return rows.select("id", review.auto_reason(F.col("quick")).alias("reason"))


@query("SELECT o_custkey % 10 AS set_id, count(*) AS n_tokens FROM orders GROUP BY 1")
def snapshot_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A token per set, the same whatever the order of rows, another after any change: both are counted here."""
    rows = tables(spark, sf, "orders")[0].withColumn("set_id", F.col("o_custkey") % 10)
    token = lambda d: status.snapshot_token(d, ["set_id"], ["o_orderkey", "o_orderstatus"])
    same = token(rows).join(token(rows.orderBy(F.desc("o_orderkey"))).withColumnRenamed("token", "again"), "set_id").where("token = again")
    return same.select("set_id").join(rows.groupBy("set_id").agg(F.count("*").alias("n_tokens")), "set_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 5")
def trash_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "orders")[0].where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prompt_text"), "o_orderdate")
    trash = status.trashed(rows, F.col("o_orderdate")).drop("prompt_text")
    return browse.searched(trash, "URGENT", ["id"], 5, 20).select("id")


@query("SELECT item_id, 'b' || (item_id % 4) || '-' || substr(sha1('analysis' || chr(31) || text), 1, 6) AS block_id FROM benchmark")
def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "benchmark")[0].select("item_id", questions.block_id(F.col("item_id") % 4, F.lit("analysis"), F.col("text")).alias("block_id"))


@query("SELECT item_id, CAST(20 AS BIGINT) AS steps, CAST(40 AS BIGINT) AS tokens FROM benchmark")
def generation_trace(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.struct(F.lit(" stage\n").alias("stage"), F.when(i % 5 == 0, -1).otherwise(F.when(i <= 20, 2).otherwise(9)).alias("tokens")))
    made = cleaners.trace(steps)
    total = F.aggregate(made, F.lit(0), lambda a, s: a + s["tokens"])
    return tables(spark, sf, "benchmark")[0].select("item_id", long(F.size(made), "steps"), long(total + F.size(F.filter(made, lambda s: s["tokens"] == 0)) * 2, "tokens"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'model' ELSE 'rule' END AS \"by\", CASE WHEN item_id % 3 = 0 THEN 'unknown' ELSE 'B' END AS answer FROM benchmark")
def selective_organise(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    blocks = tables(spark, sf, "benchmark")[0].select(i.alias("id"), F.concat(F.lit("1. stem\nA. x\nB. y"), F.when(i % 3 == 0, "").otherwise("\nAnswer: B")).alias("text"))
    made = audits.organised(blocks, questions.numbered, lambda d: d.withColumn("answer", F.lit("unknown")))
    return made.select(F.col("id").alias("item_id"), "by", "answer")

"""The catalogue: routing, clues, envelopes, patches and batches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import batches, delta, exchange, formats, routing, sets
from ..sources.readers import tables
from .catalog import long, query

# --- routing ----------------------------------------------------------------------------------------------------------

NAMES = {"en": "外科", "fr": "内科学", "de": "诊断学", "es": "解剖学"}
ROUTES = """(SELECT doc_id AS library_id, CASE lang WHEN 'en' THEN '外科学' WHEN 'fr' THEN '内科学' WHEN 'de' THEN '诊断学' WHEN 'es' THEN '解剖学' END AS subject FROM documents WHERE lang IS NOT NULL AND doc_id % 5 <> 0)"""


@query(f"""WITH l AS {ROUTES}, q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN '外科学' WHEN 1 THEN '解剖学' ELSE '内科学' END AS own FROM benchmark),
g AS (SELECT * FROM (VALUES ('外科学', '解剖学'), ('外科学', '诊断学'), ('解剖学', '外科学'), ('解剖学', '诊断学'), ('内科学', '诊断学')) AS t(own, other))
SELECT query_id, CAST(count_if(subject = own) AS BIGINT) AS n_primary, CAST(count_if(subject <> own) AS BIGINT) AS n_secondary FROM q JOIN l ON subject = own OR EXISTS (SELECT 1 FROM g WHERE g.own = q.own AND g.other = l.subject) GROUP BY query_id""")
def library_route(spark: SparkSession, sf: str) -> DataFrame:
    """Libraries of and beside each question's subject; files that are not ready, or have no page, are left out."""
    i = F.col("doc_id")
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    held = tables(spark, sf, "documents")[0].where("lang IS NOT NULL").select(i.alias("library_id"), names[F.col("lang")].alias("subject"), F.when(i % 5 == 0, F.when(i % 2 == 0, "error").otherwise("ready")).alias("file_status"), F.when(i % 5 == 0, F.when(i % 2 == 0, 3).otherwise(0)).alias("file_count"))
    own = F.element_at(F.array(F.lit(" 外科 "), F.lit("解剖学"), F.lit("内科学")), (F.col("item_id") % 3 + 1).cast("int"))
    found = routing.routed(tables(spark, sf, "benchmark")[0].select(F.col("item_id").alias("query_id"), own.alias("subject")), routing.usable(held))
    n = lambda role: F.count_if(F.col("role") == role)
    return found.groupBy("query_id").agg(n("primary").alias("n_primary"), n("secondary").alias("n_secondary"))


KINDS = {"long": "[a-z]{9}", "the": "(?i)the |le |der |el "}


@query(r"""WITH s AS (SELECT item_id, unnest(p) AS t, unnest(generate_series(1, len(p))) AS i FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[。；;！？!?\n]'), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '') AS p FROM benchmark)),
k AS (SELECT item_id, t, i, 1 AS kind FROM s WHERE regexp_matches(t, '[a-z]{9}') UNION ALL SELECT item_id, t, i, 2 FROM s WHERE regexp_matches(t, '(?i)the |le |der |el ')),
r AS (SELECT item_id, kind, substr(t, 1, 220) AS t FROM (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY least(180, length(t)) DESC, i) AS r FROM k) WHERE r = 1)
SELECT b.item_id, coalesce((SELECT string_agg(CASE kind WHEN 1 THEN 'long' ELSE 'the' END || '=' || md5(t), ',' ORDER BY kind) FROM r WHERE r.item_id = b.item_id), '') AS clues FROM benchmark b""")
def case_clues(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "benchmark")[0]
    return rows.select("item_id", F.array_join(F.transform(routing.case_clues(F.col("text"), F.lit(""), kinds=KINDS), lambda c: F.concat(c["label"], F.lit("="), F.md5(c["text"]))), ",").alias("clues"))


@query("""SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 1 ELSE 2 END :: BIGINT AS n, md5(trim(substr(text, 1, 500) || ' B. two')) AS first_md5 FROM benchmark WHERE trim(text) <> ''""")
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "benchmark")[0].where(F.trim("text") != "")
    kind = F.element_at(F.array(F.lit("a2"), F.lit("A1"), F.lit(""), F.lit(None)), (F.col("item_id") % 4 + 1).cast("int"))
    clues = F.array(F.struct(F.lit("c").alias("label"), F.lit("a clue").alias("text")), F.struct(F.lit("d").alias("label"), F.lit(" a clue").alias("text")))
    found = routing.search_texts(kind, F.col("text"), F.lit("prompt"), F.lit("b"), F.array(F.lit("A. one"), F.lit("B. two"), F.lit("C) b")), clues)
    return rows.select("item_id", long(F.size(found), "n"), F.md5(F.get(found, F.lit(0))["text"]).alias("first_md5"))


# --- envelopes and patches --------------------------------------------------------------------------------------------

SCHEMA = "example.question-set"


def exchanged(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return tables(spark, sf, "benchmark")[0].select(i.alias("id"), F.when(i % 3 == 0, "kaoyan").otherwise("school").alias("bank"), F.col("text").alias("question"), F.when(i % 2 == 0, F.array(F.lit("t"))).alias("tags"))


@query(f"""WITH q AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'kaoyan' ELSE 'school' END AS bank, text FROM benchmark)
SELECT bank, count(*) AS n_questions, '{SCHEMA}' AS schema, 2 :: BIGINT AS version, bank || '-questions' AS name, count(*) AS n_meta, true AS valid, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, min(id) AS first_id, CAST(1 AS BIGINT) AS n_tags FROM q GROUP BY bank""")
def question_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes read back: their heads, and what their questions hold."""
    tags = spark.createDataFrame([(" s\n", "label", ["a", "b"], "odd", -4, None), ("", "x", None, "active", 1, None)], "subject string, label string, aliases array<string>, status string, usage int, merged_into string")
    made = exchange.envelopes(exchanged(spark, sf), SCHEMA, "", "test", "2026-01-01T00:00:00Z", tags)
    kind = "schema string, schemaVersion int, meta struct<name:string,bank:string,source:string,exportedAt:string,questionCount:int>, tagCatalog array<struct<subject:string,label:string,usageCount:bigint,status:string>>, questions array<struct<id:bigint,bank:string,question:string,tags:array<string>>>"
    e = F.from_json("document", kind)
    good = exchange.is_envelope(F.col("document"), SCHEMA) & (e["meta"]["bank"] == F.col("bank")) & F.forall(e["questions"], lambda q: q["bank"] == F.col("bank")) & (F.get(e["tagCatalog"], F.lit(0))["status"] == "active") & (F.get(e["tagCatalog"], F.lit(0))["usageCount"] == 0)
    chars = F.aggregate(e["questions"], F.lit(0).cast("long"), lambda acc, q: acc + F.coalesce(F.char_length(q["question"]), F.lit(0)))
    return made.select("bank", long("n_questions"), e["schema"].alias("schema"), long(e["schemaVersion"], "version"), e["meta"]["name"].alias("name"), long(e["meta"]["questionCount"], "n_meta"), good.alias("valid"), chars.alias("chars"), F.get(e["questions"], F.lit(0))["id"].alias("first_id"), long(F.size(e["tagCatalog"]), "n_tags"))


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS grade, CASE WHEN item_id % 2 = 0 THEN 'case_chain' ELSE '' END AS kind, CAST(least(20, greatest(0, item_id - 5)) AS BIGINT) AS complexity, 'a,b' AS reasons FROM benchmark""")
def explanation_meta(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    mode = F.element_at(F.array(F.lit("textbook"), F.lit(" textbook_reasoning "), F.lit("general_knowledge"), F.lit("other")), (i % 4 + 1).cast("int"))
    m = F.struct(
        mode.alias("mode"), F.lit(None).cast("string").alias("model"), F.when(i % 4 == 1, "b").alias("evidence_grade"), F.when(i % 2 == 0, "case_chain").otherwise("guess").alias("reasoning_type"), F.lit(None).cast("boolean").alias("thinking"), F.lit(True).alias("model_fallback"),
        (i - 5).cast("int").alias("complexity"), F.lit("aa;a;bb").alias("route_reasons"), F.lit(99).alias("request_count"), F.lit(0.5).alias("score"), F.lit("").alias("generated_at"), F.lit("").alias("reviewed_at"), F.lit("").alias("warnings"),
    )
    found = tables(spark, sf, "benchmark")[0].select("item_id", exchange.meta(m).alias("m"))
    return found.select("item_id", F.col("m.evidenceGrade").alias("grade"), F.col("m.reasoningType").alias("kind"), long("m.complexityScore", "complexity"), F.array_join(F.transform("m.routeReasons", lambda x: F.substring(x, 1, 1)), ",").alias("reasons"))


PATCHED = """j AS (SELECT o_orderkey, o_custkey % 50 = 0 AS bad, o_orderkey % 13 = 0 AS new, o_orderkey % 31 = 0 AS moved, o_orderkey % 7 = 0 AS s, o_orderkey % 11 = 0 AND o_orderpriority <> 'x' AS p, o_orderstatus, o_orderpriority FROM orders),
r AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN new THEN 'no baseline' WHEN moved THEN 'core changed' ELSE '' END AS reason FROM j)"""


def outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = tables(spark, sf, "orders")[0].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    errors = F.when(F.col("o_custkey") % 50 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    now = base.withColumn("errors", errors).withColumns({"o_custkey": F.col("o_custkey") + F.when(k % 31 == 0, 1).otherwise(0), "o_orderstatus": F.concat("o_orderstatus", F.when(k % 7 == 0, "*").otherwise("")), "o_orderpriority": F.when(k % 11 == 0, "x").otherwise(F.col("o_orderpriority"))})
    return now, delta.preflight(now, base.where(k % 13 != 0), "o_orderkey", ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("WITH " + PATCHED + """ SELECT o_orderkey, concat_ws(',', CASE WHEN s THEN 'o_orderstatus' END, CASE WHEN p THEN 'o_orderpriority' END) AS fields, CASE WHEN s THEN o_orderstatus END AS was_status, CASE WHEN p THEN o_orderpriority END AS was_priority FROM r WHERE reason = '' AND (s OR p)""")
def delta_patches(spark: SparkSession, sf: str) -> DataFrame:
    now, found = outcomes(spark, sf)
    sent = exchange.patched(now.drop("errors"), found, "o_orderkey", "patch")
    p = F.from_json(F.col("extensions")["patch"], "version int, fields array<string>, baseValues struct<o_orderstatus:string,o_orderpriority:string>")
    return sent.select("o_orderkey", F.array_join(p["fields"], ",").alias("fields"), p["baseValues"]["o_orderstatus"].alias("was_status"), p["baseValues"]["o_orderpriority"].alias("was_priority"))


@query("WITH " + PATCHED + """ SELECT CAST(count_if(reason = '' AND (s OR p)) AS BIGINT) AS ready, CAST(count_if(reason = '' AND NOT (s OR p)) AS BIGINT) AS unchanged, 3 :: BIGINT AS pending, CAST(count_if(reason <> '') AS BIGINT) AS issues, CAST(count_if(reason = 'invalid') AS BIGINT) AS invalid, CAST(count_if(reason = 'core changed') AS BIGINT) AS moved FROM r""")
def delta_report(spark: SparkSession, sf: str) -> DataFrame:
    _, found = outcomes(spark, sf)
    return exchange.delta_report(found, 3).select("ready", "unchanged", "pending", "issues", F.col("reasons")["invalid"].alias("invalid"), F.col("reasons")["core changed"].alias("moved"))


# --- batches ----------------------------------------------------------------------------------------------------------

DRAFT = """b AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'school' WHEN 'fr' THEN 'kaoyan' END AS bank, CAST(doc_id % 400 AS VARCHAR) AS id, md5(coalesce(text, '')) AS core, md5(coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END) AS content, source AS answer, doc_id % 5 = 0 AS old FROM documents),
v AS (SELECT *, old OR (bank IS NOT NULL AND doc_id % 17 <> 0) AS valid, CASE WHEN old THEN -1 ELSE doc_id END AS o FROM b WHERE NOT old OR bank IS NOT NULL),
i AS (SELECT bank, id, min(content) <> max(content) AS d, min(answer) <> max(answer) AS a, min(o) AS f FROM v WHERE valid GROUP BY 1, 2), c AS (SELECT core, min(content) <> max(content) AS d, min(answer) <> max(answer) AS a, min(o) AS f FROM v WHERE valid GROUP BY 1),
j AS (SELECT v.*, CASE WHEN NOT valid THEN concat_ws('; ', CASE WHEN doc_id % 17 = 0 THEN 'broken' END, CASE WHEN v.bank IS NULL THEN 'no bank' END) WHEN (i.d OR c.d) AND (i.a OR c.a) THEN 'answer conflict' WHEN i.d OR c.d THEN 'content conflict' WHEN least(i.f, c.f) <> o THEN 'duplicate' ELSE '' END AS reason FROM v LEFT JOIN i ON i.bank = v.bank AND i.id = v.id LEFT JOIN c ON c.core = v.core WHERE NOT old),
draft AS (SELECT doc_id AS ordinal, bank, id, CASE WHEN reason = '' THEN 'ready' WHEN reason = 'duplicate' THEN 'duplicate' ELSE 'issue' END AS status, reason FROM j)"""


def draft(spark: SparkSession, sf: str) -> DataFrame:
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    rows = tables(spark, sf, "documents")[0].select(i.alias("ordinal"), F.col("source"), i.alias("number"), F.when(F.col("lang") == "en", "school").when(F.col("lang") == "fr", "kaoyan").alias("bank"), (i % 400).cast("string").alias("id"), F.md5(t).alias("core"), F.md5(F.concat(t, F.when(i % 11 == 0, "x").otherwise(""))).alias("content"), F.col("source").alias("answer"), F.when(i % 17 == 0, F.array(F.lit("broken"))).alias("errors"))
    old = rows.where("ordinal % 5 = 0 AND bank IS NOT NULL")
    return batches.preview(rows.where("ordinal % 5 <> 0"), old, "draft")


@query("WITH " + DRAFT + " SELECT ordinal, status, reason FROM draft")
def batch_preview(spark: SparkSession, sf: str) -> DataFrame:
    return draft(spark, sf).select("ordinal", "status", "reason")


@query("WITH " + DRAFT + " SELECT count(*) AS total, CAST(count_if(status = 'ready') AS BIGINT) AS ready, CAST(count_if(status = 'duplicate') AS BIGINT) AS duplicates, CAST(count_if(status = 'issue') AS BIGINT) AS issues FROM draft")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return batches.summary(draft(spark, sf)).drop("draft_id")


@query("WITH " + DRAFT + " SELECT 'import · ' || bank AS name, 'batch://draft' AS source_path, count(*) AS question_count, CAST(count(DISTINCT id) AS BIGINT) AS n_ids FROM draft WHERE status = 'ready' GROUP BY bank")
def batch_commit(spark: SparkSession, sf: str) -> DataFrame:
    sets, rows = batches.committed(draft(spark, sf), "import")
    return sets.join(rows.groupBy("set_id").agg(F.count_distinct("external_id").alias("n_ids")), "set_id").select("name", "source_path", "question_count", "n_ids")


# --- sets -------------------------------------------------------------------------------------------------------------

OWNED = """s AS (SELECT n_nationkey AS set_id, n_name AS name FROM nation WHERE n_nationkey % 6 <> 5),
q AS (SELECT c_custkey AS id, c_nationkey AS set_id, c_custkey % 7 AS external_id FROM customer WHERE c_custkey % 3 <> 0),
j AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'done' ELSE 'failed' END AS status, o_custkey AS c FROM orders WHERE o_orderkey % 9 = 0)"""


def owned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations as sets, some of which are gone, and customers as their questions."""
    n, c = tables(spark, sf, "nation", "customer")
    held = n.where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("set_id"), F.col("n_name").alias("name"))
    return held, c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("set_id"), (F.col("c_custkey") % 7).alias("external_id"))


@query("WITH " + OWNED + """, n AS (SELECT DISTINCT c_nationkey AS set_id, c_custkey % 11 AS external_id FROM customer WHERE c_custkey % 3 = 0),
f AS (SELECT set_id, external_id FROM n WHERE set_id IN (SELECT set_id FROM s) AND (set_id, external_id) NOT IN (SELECT (set_id, external_id) FROM q))
SELECT set_id, (SELECT count(*) FROM q WHERE q.set_id = s.set_id) + (SELECT count(*) FROM f WHERE f.set_id = s.set_id) AS question_count, (SELECT count(*) FROM f WHERE f.set_id = s.set_id) AS n_new FROM s""")
def set_append(spark: SparkSession, sf: str) -> DataFrame:
    held, rows = owned(spark, sf)
    new = tables(spark, sf, "customer")[0].where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("set_id"), (F.col("c_custkey") % 11).alias("external_id"))
    grown, _, fresh = sets.appended(held, rows, new)
    n = fresh.groupBy("set_id").agg(F.count("*").alias("n"))
    return grown.join(n, "set_id", "left").select("set_id", "question_count", F.coalesce("n", F.lit(0)).alias("n_new"))


@query("WITH " + OWNED + """, l AS (SELECT * FROM q WHERE id % 5 <> 0) SELECT set_id, (SELECT count(*) FROM l WHERE l.set_id = s.set_id) AS question_count, (SELECT count(*) FROM orders JOIN l ON l.id = o_custkey WHERE l.set_id = s.set_id) AS n_children FROM s""")
def question_delete(spark: SparkSession, sf: str) -> DataFrame:
    held, rows = owned(spark, sf)
    children = tables(spark, sf, "orders")[0].select("o_orderkey", F.col("o_custkey").alias("question_pk"))
    counted, left, found = sets.removed(rows.where("id % 5 = 0"), held, rows, {"orders": children})
    n = found["orders"].join(left.select(F.col("id").alias("question_pk"), "set_id"), "question_pk").groupBy("set_id").agg(F.count("*").alias("n"))
    return counted.join(n, "set_id", "left").select("set_id", "question_count", F.coalesce("n", F.lit(0)).alias("n_children"))


@query("WITH " + OWNED + """, r AS (SELECT DISTINCT job_id, status, coalesce(q.set_id, 0) AS set_id FROM j LEFT JOIN q ON q.id = j.c AND j.job_id % 2 = 0 WHERE CASE WHEN job_id % 2 = 0 THEN q.id IS NOT NULL ELSE job_id % 5 <> 0 END)
SELECT set_id, (SELECT count(*) FROM r WHERE r.set_id = s.set_id) AS n_jobs, (SELECT count(*) FROM r WHERE r.set_id = s.set_id AND status = 'queued') = 0 AS deletable FROM s""")
def set_deletable(spark: SparkSession, sf: str) -> DataFrame:
    """Even jobs name a question, one by itself or in a list; odd ones the set 0, or are not readable."""
    held, rows = owned(spark, sf)
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    one = F.to_json(F.struct(c.alias("question_pk")))
    many = F.concat(F.lit('{"question_ids":["x",'), c, F.lit("]}"))
    payload = F.when(k % 2 == 0, F.when(k % 4 == 0, one).otherwise(many)).when(k % 5 == 0, F.lit("{broken")).otherwise(F.lit('{"set_id":"0"}'))
    jobs = tables(spark, sf, "orders")[0].where("o_orderkey % 9 = 0").select(k.alias("job_id"), F.when(k % 4 == 0, "queued").when(k % 4 == 1, "done").otherwise("failed").alias("status"), payload.alias("payload"))
    return sets.deletable(jobs, held, rows)


@query("WITH " + OWNED + " SELECT c_custkey AS id, coalesce(s.name, 'gone') AS set_name FROM customer LEFT JOIN s ON s.set_id = c_nationkey")
def trash_names(spark: SparkSession, sf: str) -> DataFrame:
    held, _ = owned(spark, sf)
    rows = tables(spark, sf, "customer")[0].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("set_id"))
    return sets.trash_list(rows, held, "gone").select("id", "set_name")


@query("SELECT o_orderkey AS job_id, o_orderstatus AS kind FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def next_job(spark: SparkSession, sf: str) -> DataFrame:
    jobs = tables(spark, sf, "orders")[0].select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderstatus").alias("kind"))
    return sets.next_job(jobs).select("job_id", "kind")


@query("""SELECT doc_id, NOT (doc_id % 2 = 0) OR length(trim(coalesce(text, ''))) = 0 OR doc_id % 3 = 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 <> 0) OR doc_id % 13 = 0 AS manual FROM documents""")
def manual_gate(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    sections = F.when(i % 7 == 0, F.array(F.lit("analysis"))).otherwise(F.array(F.lit("pitfalls"), F.lit("analysis"), F.lit("answerBasis")))
    found = sets.needs_manual(F.col("text"), i % 2 == 0, i % 3 == 0, i % 5 != 0, F.lit(True), sections, i % 11 == 0, i % 13 == 0)
    return tables(spark, sf, "documents")[0].select("doc_id", found.alias("manual"))


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 1 ELSE least(10, n_nationkey) END AS BIGINT) AS version, CASE WHEN n_nationkey % 2 = 0 THEN 'analysis-tool' ELSE n_name END AS generator, n_nationkey % 4 <> 0 AS active FROM nation")
def card_meta(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = tables(spark, sf, "nation")[0]
    m = sets.card_meta(n.cast("int"), F.when(n % 2 == 0, F.lit(" \n")).otherwise(F.col("n_name")), F.lit(None).cast("string"))
    live = sets.deactivated(rows.select(n.alias("library_id"), F.lit(True).alias("active")), rows.where(n % 4 == 0).select(n.alias("library_id")))
    return rows.select(n, m.alias("m")).join(live, F.col("n_nationkey") == F.col("library_id")).select("n_nationkey", long("m.schemaVersion", "version"), F.col("m.generator").alias("generator"), "active")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(4 * len(embedding) AS BIGINT) AS bytes, true AS same FROM embeddings WHERE embedding IS NOT NULL")
def vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "embeddings")[0].where("embedding IS NOT NULL").select("vec_id", "embedding", vectors.encoded(F.col("embedding")).alias("data"))
    return rows.select("vec_id", long(F.size("embedding"), "n"), long(F.length("data"), "bytes"), (vectors.decoded(F.col("data"), F.size("embedding")) == F.col("embedding")).alias("same"))


# --- fields -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '{formats.LABELS['B']}' WHEN 1 THEN '{formats.LABELS['X']}' WHEN 2 THEN '{formats.LABELS['A3A4']}' WHEN 3 THEN '{formats.LABELS['A4']}' WHEN 4 THEN '{formats.LABELS['A2']}' WHEN 5 THEN '{formats.LABELS['judge']}' ELSE '' END AS label,
CASE doc_id % 4 WHEN 0 THEN 'CA' WHEN 1 THEN '正确' WHEN 2 THEN '错误' ELSE 'gut' END AS answer FROM documents""")
def type_labels(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (i % n + 1).cast("int"))
    label = formats.type_label(pick(7, " b1 ", "x", "A3 / a4", "a4", "", "", "?"), pick(7, "", "", "", "", "A2", "judge", "fill"))
    return tables(spark, sf, "documents")[0].select("doc_id", label.alias("label"), formats.answer(pick(4, "c,a c", " 对", "x ", " gut. ")).alias("answer"))


@query(r"""SELECT item_id, substr(trim(regexp_replace(split_part(regexp_replace(t, '([。！？!?])\s*', '\1' || chr(1)), chr(1), 1), '\s+', ' ', 'g')), 1, 160) AS brief, 'A. x|B. y z|C. third' AS options FROM (SELECT item_id, trim(regexp_replace('' || text, '\s+', ' ', 'g')) AS t FROM benchmark)""")
def short_texts(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array(F.lit("A. x  b、 y z"), F.lit(" "), F.lit("third"))
    return tables(spark, sf, "benchmark")[0].select("item_id", formats.brief(F.lit(""), F.col("text")).alias("brief"), F.array_join(formats.options(lines), "|").alias("options"))


@query("""SELECT item_id, CASE WHEN trim(text) <> '' THEN 'analysis/paragraph,' ELSE '' END || CASE WHEN item_id % 2 = 0 THEN 'pitfalls/table,' ELSE '' END || 'analysis/list,pitfalls/callout' AS kinds, md5(CASE WHEN trim(text) <> '' THEN trim(text) ELSE '' END) AS text_md5 FROM benchmark WHERE text NOT LIKE '%<%' AND length(text) < 4000""")
def normal_blocks(spark: SparkSession, sf: str) -> DataFrame:
    kind = "struct<section:string,type:string,title:string,text:string,items:array<string>,columns:array<string>,rows:array<array<string>>,tone:string>"
    null = F.lit(None)
    block = lambda **f: F.struct(*(f.get(n, null).alias(n) for n in ("section", "type", "title", "text", "items", "columns", "rows", "tone"))).cast(kind)
    words = lambda *x: F.array(*map(F.lit, x))
    columns = F.when(F.col("item_id") % 2 == 0, words("a", " ", "<b>b</b>")).otherwise(words("a"))
    found = F.array(block(section=F.lit("odd"), type=F.lit("odd"), text=F.col("text")), block(section=F.lit("pitfalls"), type=F.lit("table"), columns=columns, rows=F.array(words("x"), words("", ""))), block(type=F.lit("list"), text=F.lit("one\n\ntwo")), block(type=F.lit("list"), items=words(" ")), block(section=F.lit("pitfalls"), type=F.lit("callout"), text=F.lit("mind"), tone=F.lit("loud")))
    rows = tables(spark, sf, "benchmark")[0].where(~F.col("text").like("%<%") & (F.char_length("text") < 4000)).select("item_id", "text", formats.blocks(found).alias("b"))
    first = F.get("b", F.lit(0))
    own = F.when(first["type"] == "paragraph", first["text"]).otherwise("")
    return rows.select("item_id", F.array_join(F.transform("b", lambda x: F.concat(x["section"], F.lit("/"), x["type"])), ",").alias("kinds"), F.md5(own).alias("text_md5"))


@query("""WITH r AS (SELECT doc_id, CAST(doc_id % 300 AS VARCHAR) AS id FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 9 = 0 THEN 'bad' END, CASE WHEN (SELECT min(doc_id) FROM r f WHERE f.id = r.id) < doc_id THEN 'id as in row ' || (SELECT min(doc_id) FROM r f WHERE f.id = r.id) END, CASE WHEN CAST(id AS BIGINT) IN (SELECT item_id FROM benchmark) THEN 'id is imported' END) AS warnings FROM r""")
def row_warnings(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    rows = tables(spark, sf, "documents")[0].select(i, F.concat(F.lit(" "), (i % 300).cast("string")).alias("id"), i.alias("ordinal"), F.when(i % 9 == 0, F.array(F.lit("bad"))).alias("errors"))
    found = formats.warnings(rows, tables(spark, sf, "benchmark")[0].select(F.col("item_id").alias("id")))
    return found.select("doc_id", F.array_join("warnings", ";").alias("warnings"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 2 = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 0)")
def legacy_profiles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    files = tables(spark, sf, "nation")[0].select(n, n.alias("file_id"), F.when(n % 5 == 0, "error").otherwise("ready").alias("status"), F.when(n % 2 == 1, "f").alias("fingerprint"))
    chunks = tables(spark, sf, "customer")[0].select(F.col("c_nationkey").alias("file_id"), F.when(F.col("c_custkey") % 40 == 0, 512).otherwise(1024).alias("dim"))
    return formats.adoptable(files, chunks, 1024).select("n_nationkey")

"""The catalogue's second half: browsing, roll-ups, checks, pages, tags, duplicates, states, reviews, exports, scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import browse, dedup, delta, models, pages, questions, review, status, tags
from ..sources.readers import mapped, tables
from ..sources.writers import cells, remapped
from ..streaming.index import job_activity
from .catalog import long, query

# --- browsing and roll-ups --------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_orders, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS n_open, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_done, CAST(count_if(o_totalprice > 200000) AS BIGINT) AS n_large FROM orders")
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return browse.counts(tables(spark, sf, "orders")[0], n_orders=F.lit(True), n_open=s == "O", n_done=s == "F", n_large=F.col("o_totalprice") > 200000)


@query("SELECT c_custkey, coalesce(n, 0) AS n_all, coalesce(a, 0) AS n_approved, coalesce(u, 0) AS n_unmatched FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS a, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS u FROM orders GROUP BY 1) USING (c_custkey)")
def set_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c, o = tables(spark, sf, "customer", "orders")
    s = F.col("o_orderstatus")
    found = browse.rollup(c.select("c_custkey"), o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", {"n_all": F.count("*"), "n_approved": F.count_if(s == "F"), "n_unmatched": F.count_if(s == "P")})
    return found.select("c_custkey", long("n_all"), long("n_approved"), long("n_unmatched"))


@query("SELECT r_name, n_nationkey, coalesce(n, 0) AS files, coalesce(p, 0) AS pages, coalesce(m, 0) AS largest FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n, CAST(sum(s_suppkey % 100) AS BIGINT) AS p, CAST(max(s_suppkey) AS BIGINT) AS m FROM supplier WHERE s_acctbal > 0 GROUP BY 1) USING (n_nationkey)")
def library_rollup(spark: SparkSession, sf: str) -> DataFrame:
    n, r, s = tables(spark, sf, "nation", "region", "supplier")
    parents = n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_nationkey")
    found = browse.rollup(parents, s.withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", {"files": F.count("*"), "pages": F.sum(F.col("s_suppkey") % 100), "largest": F.max("s_suppkey")}, F.col("s_acctbal") > 0)
    return found.select("r_name", "n_nationkey", long("files"), long("pages"), long("largest"))


@query("SELECT o_orderstatus AS pipeline_status, count(*) AS n FROM orders GROUP BY 1")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "orders")[0].groupBy(F.col("o_orderstatus").alias("pipeline_status")).agg(F.count("*").alias("n"))


@query("SELECT CAST(count_if(o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS BIGINT) AS active_jobs, count(DISTINCT o_orderpriority) AS kinds FROM orders")
def lifecycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    (o,) = tables(spark, sf, "orders")
    return o.agg(F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("active_jobs"), F.count_distinct("o_orderpriority").alias("kinds"))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as question rows, with states by id."""
    (d,) = tables(spark, sf, "documents")
    i = F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.floor(i / n) % len(names) + 1).cast("int"))
    return d.select(
        i.alias("id"),
        F.col("lang").alias("subject"),
        F.col("source").alias("question_source"),
        F.coalesce("text", F.lit("")).alias("prompt_text"),
        pick(["pending", "approved", "rejected"], 1).alias("review_status"),
        pick(["generated", "unmatched", "error", "no_library", "queued"], 1).alias("pipeline_status"),
        pick(["matched", "unmatched", "matched"], 1).alias("retrieval_status"),
        pick(["generated", "validation_error", "provider_error", "pending"], 1).alias("generation_status"),
        pick(["textbook", "general_knowledge", "textbook_reasoning"], 3).alias("generation_mode"),
        (i % 100 / 100.0).alias("match_score"),
        F.array(F.concat(F.lit("tag"), (i % 7).cast("string"))).alias("tags"),
        F.array(F.concat(F.lit("tag"), (i % 5).cast("string")), F.lit("extra")).alias("suggested"),
        F.when(i % 4 == 0, "B").alias("grade"),
    )


BANK = """bank AS (SELECT doc_id AS id, lang AS subject, source AS question_source, coalesce(text, '') AS prompt_text,
  list_extract(['pending', 'approved', 'rejected'], doc_id % 3 + 1) AS review_status, list_extract(['generated', 'unmatched', 'error', 'no_library', 'queued'], doc_id % 5 + 1) AS pipeline_status,
  list_extract(['matched', 'unmatched', 'matched'], doc_id % 3 + 1) AS retrieval_status, list_extract(['generated', 'validation_error', 'provider_error', 'pending'], doc_id % 4 + 1) AS generation_status,
  list_extract(['textbook', 'general_knowledge', 'textbook_reasoning'], (doc_id // 3) % 3 + 1) AS generation_mode, (doc_id % 100) / 100.0 AS match_score,
  ['tag' || (doc_id % 7)] AS tags, ['tag' || (doc_id % 5), 'extra'] AS suggested, CASE WHEN doc_id % 4 = 0 THEN 'B' END AS grade FROM documents)"""


@query("WITH " + BANK + """ SELECT id, subject, array_to_string(tags || list_filter(suggested, lambda t: NOT list_contains(tags, t)), ',') AS all_tags, coalesce(grade, CASE generation_mode WHEN 'textbook' THEN 'A' WHEN 'textbook_reasoning' THEN 'B' WHEN 'general_knowledge' THEN 'C' ELSE '' END) AS grade
FROM bank WHERE subject = 'en' AND (list_contains(tags, 'tag3') OR list_contains(suggested, 'tag3'))""")
def faceted_browse(spark: SparkSession, sf: str) -> DataFrame:
    found = browse.listed(bank(spark, sf).where(browse.conjunction(subject="en", tag="tag3")))
    return found.select("id", "subject", F.array_join("all_tags", ",").alias("all_tags"), "grade")


@query("WITH " + BANK + " SELECT id FROM bank WHERE review_status = 'pending' AND retrieval_status = 'matched' AND generation_status IN ('validation_error', 'provider_error') AND (contains(CAST(id AS VARCHAR), 'an') OR contains(lower(prompt_text), 'an'))")
def ids_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    return bank(spark, sf).where(browse.conjunction(review="pending", pipeline="matched_generation_error", search="AN")).select("id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def pagination(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "orders")[0].where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")
    return browse.page(rows, ["o_orderkey"], 100, 50)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_facets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return tables(spark, sf, "events")[0].select("event_type", k.alias("k")).where("k IS NOT NULL").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 100000)")
def orphan_check(spark: SparkSession, sf: str) -> DataFrame:
    items, orders = tables(spark, sf, "lineitem", "orders")
    known = orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return items.join(known, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""WITH p AS (SELECT count(*) AS n_pages, min(doc_id + 1) = 1 AS from_one, max(doc_id + 1) = count(*) AS to_last, CAST(count_if(n_chars < 40) AS BIGINT) AS n_errors FROM documents),
c AS (SELECT count(*) AS n_chunks, CAST(count_if(embedding IS NULL) AS BIGINT) AS n_null, min(len(embedding)) = max(len(embedding)) AS one_dim, CAST(count_if(vec_id NOT IN (SELECT doc_id FROM documents)) AS BIGINT) AS n_orphans FROM embeddings)
SELECT *, from_one AND to_last AND one_dim AND n_null = 0 AND n_orphans = 0 AS valid FROM p CROSS JOIN c""")
def stage_validate(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = tables(spark, sf, "documents", "embeddings")
    p = docs.select((F.col("doc_id") + 1).alias("page_number"), F.when(F.col("n_chars") < 40, "short").otherwise("").alias("error"))
    c = vectors.select((F.col("vec_id") + 1).alias("page_number"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))
    return browse.stage_report(p, c, ["page_number"])


@query("SELECT n_nationkey, CASE WHEN s IS NULL OR s = 1 THEN 'unknown' WHEN s = 2 THEN 'compatible' ELSE 'stale' END AS compatibility FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, min(CASE s_suppkey % 9 WHEN 0 THEN 1 WHEN 5 THEN 0 ELSE 2 END) AS s FROM supplier GROUP BY 1) USING (n_nationkey)")
def index_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    n, s = tables(spark, sf, "nation", "supplier")
    files = s.select(F.col("s_nationkey").alias("library_id"), F.when(F.col("s_suppkey") % 9 == 0, "").when(F.col("s_suppkey") % 9 == 5, "old").otherwise("now").alias("index_fingerprint"))
    found = browse.compatibility(n.select(F.col("n_nationkey").alias("library_id")), files, "now")
    return found.select(F.col("library_id").alias("n_nationkey"), "compatibility")


@query("SELECT DISTINCT p_type AS value FROM part WHERE trim(p_type) <> ''")
def distinct_facets(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "part")[0].select(F.col("p_type").alias("value")).where(F.trim("value") != "").distinct()


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def job_activity_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return job_activity(tables(spark, sf, "events")[0]).withColumn("total", F.round("total", 4))


# --- pages ------------------------------------------------------------------------------------------------------------

SEEN = "seen AS (SELECT user_id % 10 AS library_id, CAST(event_id % 700 AS BIGINT) AS pdf_page, CAST(event_id % 700 - CASE WHEN event_id % 700 < 300 THEN 12 ELSE 15 END - CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END AS BIGINT) AS printed_page FROM events WHERE event_id % 3 <> 0)"
RUNS = SEEN + """,
clean AS (SELECT library_id, pdf_page, min(printed_page) AS printed_page, pdf_page - min(printed_page) AS off FROM seen GROUP BY library_id, pdf_page HAVING min(printed_page) = max(printed_page)),
marks AS (SELECT *, CASE WHEN lag(off) OVER w IS NULL OR lag(off) OVER w <> off OR pdf_page - lag(pdf_page) OVER w > 12 THEN 1 ELSE 0 END AS new FROM clean WINDOW w AS (PARTITION BY library_id ORDER BY pdf_page)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY library_id ORDER BY pdf_page) AS run FROM marks),
runs AS (SELECT library_id, off, min(pdf_page) AS pdf_start, max(pdf_page) AS pdf_end, count(*) AS support FROM numbered GROUP BY library_id, run, off HAVING count(*) >= 3 OR (count(*) = 2 AND max(pdf_page) = min(pdf_page) + 1))"""


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each event; every third one has no printed number."""
    e = F.col("event_id")
    page = (e % 700).cast("long")
    printed = page - F.when(page < 300, 12).otherwise(15) - F.when(e % 53 == 0, 1).otherwise(0)
    return tables(spark, sf, "events")[0].select((F.col("user_id") % 10).alias("library_id"), page.alias("pdf_page"), F.when(e % 3 != 0, printed).cast("long").alias("printed_page"))


@query("WITH " + RUNS + " SELECT library_id, off AS page_offset, pdf_start, pdf_end, support, CASE WHEN support >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM runs")
def page_runs(spark: SparkSession, sf: str) -> DataFrame:
    return pages.calibration_runs(seen(spark, sf)).select("library_id", F.col("offset").alias("page_offset"), "pdf_start", "pdf_end", "support", "confidence")


@query("WITH " + RUNS + """, m AS (SELECT library_id, off, unnest(generate_series(pdf_start, pdf_end)) AS pdf_page FROM runs), odd AS (SELECT library_id, pdf_page FROM seen GROUP BY 1, 2 HAVING count(DISTINCT printed_page) > 1),
pm AS (SELECT library_id, pdf_page, pdf_page - off AS printed_page FROM m WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.library_id = m.library_id AND odd.pdf_page = m.pdf_page)),
files AS (SELECT doc_id, doc_id % 12 AS library_id, doc_id % 720 AS pdf_page, doc_id % 12 < 10 AS calibrated FROM documents)
SELECT doc_id, library_id, pdf_page, CASE WHEN x > 0 THEN x END AS printed_page FROM (SELECT f.*, CASE WHEN calibrated THEN coalesce(pm.printed_page, 0) ELSE f.pdf_page - 7 END AS x FROM files f LEFT JOIN pm ON pm.library_id = f.library_id AND pm.pdf_page = f.pdf_page)""")
def printed_page(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import printed_page as printed

    rows = seen(spark, sf)
    found = pages.page_map(pages.calibration_runs(rows), rows)
    i = F.col("doc_id")
    files = tables(spark, sf, "documents")[0].select("doc_id", (i % 12).alias("library_id"), (i % 720).alias("pdf_page"), (i % 12 < 10).alias("calibrated"))
    return printed(files, found, F.lit(7)).select("doc_id", "library_id", "pdf_page", "printed_page")


@query("WITH " + SEEN + ", c AS (SELECT library_id, pdf_page - printed_page AS off, count(*) AS support, min(pdf_page) AS first_page FROM seen GROUP BY 1, 2 HAVING count(*) >= 3) SELECT library_id, off AS page_offset, support FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY support DESC, first_page) AS r FROM c) WHERE r = 1")
def mode_offset(spark: SparkSession, sf: str) -> DataFrame:
    return pages.usual_offset(seen(spark, sf)).select("library_id", F.col("offset").alias("page_offset"), "support")


# --- tags -------------------------------------------------------------------------------------------------------------

TAGGED = """tagged AS (SELECT p_brand AS set_id, CAST(p_size % 3 AS BIGINT) AS subject, p_partkey AS question_id, CASE p_partkey % 7 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN NULL ELSE list_slice(string_split(p_type, ' '), 1, 2) END AS tags, CASE WHEN p_partkey % 7 > 1 THEN string_split(p_name, ' ') END AS suggested FROM part),
flat AS (SELECT set_id, subject, question_id, unnest(tags || suggested) AS label, unnest(generate_series(1, len(tags || suggested))) AS pos FROM tagged WHERE len(tags) > 0),
keyed AS (SELECT *, regexp_replace(lower(label), '[ \t\n._-]+', '', 'g') AS k FROM flat),
firsts AS (SELECT set_id, subject, question_id, k, min(pos) AS pos, substr(arg_min(label, pos), 1, 24) AS label FROM keyed WHERE k <> '' GROUP BY ALL),
cat AS (SELECT set_id, subject, k, count(*) AS usage, arg_min(label, question_id) AS name, CASE WHEN count(*) >= 3 THEN 'active' ELSE 'candidate' END AS status FROM firsts GROUP BY ALL)"""


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    (p,) = tables(spark, sf, "part")
    return p.select(F.col("p_brand").alias("set_id"), long(F.col("p_size") % 3, "subject"), F.col("p_partkey").alias("question_id"), F.when(F.col("p_partkey") % 7 > 1, F.slice(F.split("p_type", " "), 1, 2)).when(F.col("p_partkey") % 7 == 0, F.array().cast("array<string>")).alias("tags"), F.when(F.col("p_partkey") % 7 > 1, F.split("p_name", " ")).alias("suggested"))


@query("WITH " + TAGGED + " SELECT set_id, subject, k AS tag_key, usage, name, status FROM cat")
def tag_catalog_sync(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = tags.synced(tagged(spark, sf))
    return catalog.select("set_id", "subject", F.col("key").alias("tag_key"), "usage", "name", "status")


@query("WITH " + TAGGED + ", j AS (SELECT f.set_id, f.subject, f.question_id, f.pos, c.name, c.status, row_number() OVER (PARTITION BY f.set_id, f.subject, f.question_id, c.status ORDER BY f.pos) AS r FROM firsts f JOIN cat c USING (set_id, subject, k)) SELECT set_id, subject, question_id, coalesce(string_agg(name, ',' ORDER BY pos) FILTER (WHERE status = 'active' AND r <= 3), '') AS tags, coalesce(string_agg(name, ',' ORDER BY pos) FILTER (WHERE status = 'candidate' AND r <= 3), '') AS suggested FROM tagged LEFT JOIN j USING (set_id, subject, question_id) GROUP BY ALL")
def tag_lists_sync(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = tags.synced(tagged(spark, sf))
    return rows.select("set_id", "subject", "question_id", F.array_join("tags", ",").alias("tags"), F.array_join("suggested", ",").alias("suggested"))


@query("WITH " + TAGGED + " SELECT k AS tag_key, CAST(sum(usage) AS BIGINT) AS total, min(name) AS name FROM cat GROUP BY k")
def tag_totals(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = tags.synced(tagged(spark, sf))
    return tags.totals(catalog).select(F.col("key").alias("tag_key"), "total", "name")


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", "changed", F.array_join("tags", ",").alias("tags"), F.array_join("suggested", ",").alias("suggested"))


CASES = "SELECT doc_id AS question_id, ['alpha', 'Beta ' || (doc_id % 3)] AS tags, ['ALPHA', 'gamma'] AS suggested FROM documents"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "documents")[0].select(F.col("doc_id").alias("question_id"), F.array(F.lit("alpha"), F.concat(F.lit("Beta "), (F.col("doc_id") % 3).cast("string"))).alias("tags"), F.array(F.lit("ALPHA"), F.lit("gamma")).alias("suggested"))


@query(f"SELECT question_id, list_contains(tags, 'Beta 1') AS changed, array_to_string(list_transform(tags, lambda t: CASE WHEN t = 'Beta 1' THEN 'delta' ELSE t END), ',') AS tags, array_to_string(suggested, ',') AS suggested FROM ({CASES})")
def tag_rename(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(tags.renamed(cases(spark, sf), " beta-1", "delta"))


@query(f"SELECT question_id, true AS changed, array_to_string(list_filter(tags, lambda t: t <> 'alpha'), ',') AS tags, 'gamma' AS suggested FROM ({CASES})")
def tag_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(tags.renamed(cases(spark, sf), "Alpha", None))


@query(f"SELECT question_id, true AS changed, CASE WHEN tags[2] = 'Beta 2' THEN 'gamma' ELSE 'gamma,' || tags[2] END AS tags, '' AS suggested FROM ({CASES})")
def tag_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(tags.merged(cases(spark, sf), ["alpha", "beta 2"], "gamma"))


@query("WITH " + TAGGED + " SELECT set_id, subject, k AS tag_key FROM cat WHERE contains(lower(name), 'ol')")
def tag_search(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = tags.synced(tagged(spark, sf))
    return tags.search(catalog.withColumn("aliases", F.array().cast("array<string>")), "OL").select("set_id", "subject", F.col("key").alias("tag_key"))


# --- duplicates, states, reviews --------------------------------------------------------------------------------------


def batch(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = tables(spark, sf, "documents")
    t = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("ordinal"), F.col("lang").alias("bank"), (F.col("doc_id") % 400).cast("string").alias("id"), F.md5(t).alias("core"), F.md5(F.concat(t, F.when(F.col("doc_id") % 11 == 0, "x").otherwise(""))).alias("content"), F.col("source").alias("answer"), (F.char_length(t) >= 60).alias("valid"))


@query("""WITH b AS (SELECT doc_id AS ordinal, lang AS bank, CAST(doc_id % 400 AS VARCHAR) AS id, md5(coalesce(text, '')) AS core, md5(coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END) AS content, source AS answer, length(coalesce(text, '')) >= 60 AS valid FROM documents),
i AS (SELECT bank, id, min(content) <> max(content) AS d, min(answer) <> max(answer) AS a, min(ordinal) AS f FROM b WHERE valid GROUP BY 1, 2), c AS (SELECT core, min(content) <> max(content) AS d, min(answer) <> max(answer) AS a, min(ordinal) AS f FROM b WHERE valid GROUP BY 1),
j AS (SELECT b.*, CASE WHEN NOT valid THEN 'invalid' WHEN (i.d OR c.d) AND (i.a OR c.a) THEN 'answer conflict' WHEN i.d OR c.d THEN 'content conflict' WHEN least(i.f, c.f) <> ordinal THEN 'duplicate' ELSE '' END AS reason FROM b LEFT JOIN i ON i.bank = b.bank AND i.id = b.id LEFT JOIN c ON c.core = b.core)
SELECT ordinal, bank, id, CASE WHEN reason = '' THEN 'ready' WHEN reason = 'duplicate' THEN 'duplicate' ELSE 'issue' END AS status, reason FROM j""")
def dedup_classify(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.classify(batch(spark, sf))


@query("SELECT doc_id, CAST(r AS BIGINT) AS occurrence, 'q-' || d || CASE WHEN r > 1 THEN '-' || CAST(r AS VARCHAR) ELSE '' END AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY doc_id) AS r FROM (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS d FROM documents))")
def occurrence_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup.occurrence_ids(tables(spark, sf, "documents")[0], [F.col("text")], "doc_id")
    return rows.select("doc_id", long("occurrence"), "row_id")


@query("SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(ok) AS BIGINT) AS importable, CAST(sum(n) - sum(ok) AS BIGINT) AS missing, CAST(count_if(n > 1) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows FROM (SELECT text, count(*) AS n, count_if(length(text) >= 60) AS ok FROM documents GROUP BY text)")
def import_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.import_stats(tables(spark, sf, "documents")[0].withColumn("digest", F.md5("text")), "digest", F.char_length("text") >= 60)


DECIDED = """CASE WHEN pipeline_status = 'generated' AND g THEN CASE WHEN e THEN 'unmatched' ELSE 'no_library' END WHEN pipeline_status = 'generated' OR (pipeline_status = 'error' AND e) THEN 'matched' WHEN pipeline_status IN ('unmatched', 'no_library') THEN pipeline_status ELSE 'error' END AS retrieval,
CASE WHEN pipeline_status = 'generated' THEN 'generated' WHEN pipeline_status = 'error' AND e THEN CASE WHEN v THEN 'validation_error' ELSE 'provider_error' END ELSE 'pending' END AS generation,
CASE WHEN pipeline_status = 'generated' AND g THEN CASE WHEN e THEN 'low' ELSE 'no_library' END WHEN pipeline_status = 'generated' OR (pipeline_status = 'error' AND e) THEN CASE WHEN match_score >= 0.7 THEN 'strong' ELSE 'standard' END WHEN pipeline_status = 'unmatched' THEN 'low' WHEN pipeline_status = 'no_library' THEN 'no_library' ELSE 'error' END AS confidence"""
FLAGS = "generation_mode = 'general_knowledge' AS g, id % 2 = 0 AS e, id % 3 = 0 AS v, id % 7 = 0 AS below"


def _flags() -> tuple[Column, Column, Column, Column, Column]:
    i = F.col("id")
    return F.col("generation_mode") == "general_knowledge", i % 2 == 0, i % 3 == 0, i % 7 == 0, F.when(F.col("match_score") >= 0.7, "strong").otherwise("standard")


@query("WITH " + BANK + f", x AS (SELECT *, {FLAGS} FROM bank) SELECT id, {DECIDED} FROM x")
def status_transition(spark: SparkSession, sf: str) -> DataFrame:
    general, has, validation, _, sure = _flags()
    r, g, c = status.decided(F.col("pipeline_status"), general, has, validation, sure)
    return bank(spark, sf).select("id", r.alias("retrieval"), g.alias("generation"), c.alias("confidence"))


@query("WITH " + BANK + f", x0 AS (SELECT *, {FLAGS} FROM bank), x1 AS (SELECT *, pipeline_status = 'unmatched' AND e AND (v OR match_score >= 0.6) AND NOT below AS saved FROM x0), x AS (SELECT * REPLACE (CASE WHEN saved THEN 'error' ELSE pipeline_status END AS pipeline_status, v OR saved AS v), pipeline_status AS was FROM x1), d AS (SELECT id, was, pipeline_status AS pipeline, {DECIDED} FROM x)"
       " SELECT id, pipeline, CASE WHEN was = 'queued' THEN 'pending' ELSE retrieval END AS retrieval, CASE WHEN was = 'queued' THEN 'pending' ELSE generation END AS generation, CASE WHEN was = 'queued' THEN 'pending' ELSE confidence END AS confidence FROM d")
def backfill_axes(spark: SparkSession, sf: str) -> DataFrame:
    general, has, validation, below, sure = _flags()
    p, r, g, c = status.backfilled(F.col("pipeline_status"), general, has, validation, below, F.col("match_score"), sure)
    return bank(spark, sf).select("id", p.alias("pipeline"), r.alias("retrieval"), g.alias("generation"), c.alias("confidence"))


@query("WITH " + BANK + ", x AS (SELECT *, review_status = 'pending' AND pipeline_status = 'generated' AND generation_mode <> 'general_knowledge' AND match_score < 0.5 AS f FROM bank) SELECT id, CASE WHEN f THEN 'unmatched' ELSE pipeline_status END AS pipeline_status, CASE WHEN f THEN 'pending' ELSE generation_status END AS generation_status FROM x")
def reclassify_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = bank(spark, sf).withColumn("match_confidence", F.lit("standard"))
    return status.reclassified(rows, 0.5).select("id", "pipeline_status", "generation_status")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name || '!' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 50 = 0")
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    base = tables(spark, sf, "customer")[0].select("c_custkey", "c_name")
    changes = base.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("!"))).union(base.where("c_custkey % 50 = 0").select(F.col("c_custkey") + 1000000, F.lit("new")))
    return status.upserted(base, changes, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 50 = 0")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    base = tables(spark, sf, "customer")[0].select("c_custkey", "c_name")
    new = base.where("c_custkey % 10 = 0").select("c_custkey", F.lit("ignored")).union(base.where("c_custkey % 50 = 0").select(F.col("c_custkey") + 1000000, F.lit("new"))).toDF("c_custkey", "c_name")
    return status.inserted(base, new, ["c_custkey"])


@query("SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS purge_after FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1996-01-01'")
def trash_ttl(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "orders")[0].where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return status.purged(status.trashed(rows, F.col("o_orderdate")), F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "purge_after")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'exists' WHEN o_custkey % 13 = 0 THEN 'no parent' ELSE '' END AS problem FROM orders WHERE o_orderstatus = 'P'")
def restore_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables(spark, sf, "orders", "customer")
    trash = o.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    parents = c.where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("o_custkey")).union(o.where("o_custkey % 13 <> 0").select("o_custkey"))
    return status.restorable(trash, o.where("o_orderkey % 9 = 0"), "o_orderkey", parents, "o_custkey").select("o_orderkey", "problem")


@query("WITH " + BANK + " SELECT id, CASE WHEN id % 4 = 0 AND match_score >= 0.5 AND review_status = 'pending' THEN 'approved' ELSE review_status END AS review_status FROM bank")
def bulk_approve(spark: SparkSession, sf: str) -> DataFrame:
    rows = bank(spark, sf)
    done, _ = status.approved(rows, (F.col("match_score") >= 0.5) & (F.col("review_status") == "pending"), rows.where("id % 4 = 0"), "id")
    return done.select("id", "review_status")


def packages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as generated rows with blocks and evidence, faults by id."""
    i = F.col("id")
    rows = bank(spark, sf)
    block = lambda s, t: F.struct(F.lit(s).alias("section"), F.lit(t).alias("type"))
    whole = F.array(block("analysis", "paragraph"), block("answerBasis", "list"), block("pitfalls", "table"))
    blocks = F.when(i % 13 == 0, F.array().cast("array<struct<section:string,type:string>>")).when(i % 17 == 0, F.slice(whole, 1, 2)).when(i % 19 == 0, F.concat(whole, F.array(block("other", "list")))).otherwise(whole)
    proof = F.array(F.struct(F.when(i % 23 == 0, "").otherwise("book").alias("book"), (i % 29).cast("int").alias("printed_page"), F.substring("prompt_text", 1, 40).alias("quote"), F.lit(0.9).alias("score")))
    return rows.select(
        "id", F.lit("generated").alias("pipeline_status"), "review_status", F.when(i % 31 == 0, "general_knowledge").otherwise("textbook").alias("generation_mode"), F.when(i % 37 == 0, "failed").otherwise("").alias("error_message"), F.greatest("match_score", F.lit(0.4)).alias("match_score"),
        F.col("prompt_text").alias("explanation"), "grade", F.when(i % 41 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), blocks.alias("blocks"), "tags", "suggested", F.when(i % 43 == 0, " ").otherwise("brief").alias("brief"), proof.alias("evidence"),
    )


REASON = """CASE WHEN review_status <> 'pending' THEN 'state' WHEN id % 31 = 0 THEN 'mode' WHEN id % 37 = 0 THEN 'error' WHEN greatest(match_score, 0.4) < 0.75 THEN 'score' WHEN length(prompt_text) < 80 THEN 'short' WHEN coalesce(grade, 'A') <> 'A' THEN 'grade' WHEN id % 41 = 0 THEN 'warnings' WHEN id % 13 = 0 THEN 'no blocks' WHEN id % 19 = 0 AND id % 17 <> 0 THEN 'unknown block' WHEN id % 17 = 0 THEN 'sections' WHEN id % 43 = 0 THEN 'no brief'
WHEN id % 23 = 0 OR id % 29 = 0 OR length(trim(substr(prompt_text, 1, 40))) < 20 THEN 'weak evidence' ELSE '' END AS reason"""


@query("WITH " + BANK + f" SELECT id, {REASON} FROM bank")
def quick_review_reason(spark: SparkSession, sf: str) -> DataFrame:
    return packages(spark, sf).select("id", review.quick_reason(0.75).alias("reason"))


@query("WITH " + BANK + f", r AS (SELECT id, {REASON} FROM bank) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def review_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return review.histogram(packages(spark, sf).select(review.quick_reason(0.75).alias("reason")))


@query("WITH " + BANK + f""", r AS (SELECT id, review_status, CAST(id % 50 AS VARCHAR) AS fingerprint, {REASON} FROM bank), o AS (SELECT id, CAST(id % 50 + CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS f, CASE WHEN id % 2 = 0 THEN 'approved' ELSE 'pending' END AS d, 'before' AS was FROM bank WHERE id % 3 = 0 AND id % 5 <> 0),
x AS (SELECT r.*, coalesce(f = fingerprint, false) AS same, d, was FROM r LEFT JOIN o USING (id)),
y AS (SELECT *, CASE WHEN review_status <> 'pending' THEN 'untouched' WHEN same AND d = 'approved' THEN 'returned' WHEN same AND d = 'pending' THEN 'pending' WHEN reason = '' THEN 'approved' ELSE 'pending' END AS decision FROM x)
SELECT id, fingerprint, decision, CASE WHEN decision = 'returned' THEN 'sent back' WHEN same AND d = 'pending' THEN was ELSE reason END AS reason FROM y""")
def auto_review_memo(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = packages(spark, sf).select("id", "review_status", (i % 50).cast("string").alias("fingerprint"), review.quick_reason(0.75).alias("reason"))
    before = bank(spark, sf).where((i % 3 == 0) & (i % 5 != 0)).select("id", (i % 50 + F.when(i % 8 == 0, 1).otherwise(0)).cast("string").alias("fingerprint"), F.when(i % 2 == 0, "approved").otherwise("pending").alias("decision"), F.lit("before").alias("reason"))
    return review.memoised(rows, before)


@query("WITH " + BANK + " SELECT id, CASE WHEN trim(prompt_text) = '' THEN 'blank' WHEN trim(prompt_text) LIKE '{%' THEN 'raw dump' WHEN id % 13 = 0 THEN 'no blocks' WHEN id % 17 = 0 THEN 'sections' ELSE '' END AS reason FROM bank")
def tag_repair_reason(spark: SparkSession, sf: str) -> DataFrame:
    return packages(spark, sf).select("id", review.repair_reason(F.col("generation_mode") == "general_knowledge").alias("reason"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS k, o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN '*' ELSE '' END AS s, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderpriority END AS p FROM orders),
j AS (SELECT c.*, o.o_custkey AS ok, o.o_orderstatus AS os, o.o_orderpriority AS op FROM c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 13 <> 0) o USING (o_orderkey)),
r AS (SELECT *, CASE WHEN ok IS NULL THEN 'no baseline' WHEN k <> ok THEN 'core changed' ELSE '' END AS reason, concat_ws(',', CASE WHEN s IS DISTINCT FROM os THEN 'o_orderstatus' END, CASE WHEN p IS DISTINCT FROM op THEN 'o_orderpriority' END) AS f FROM j)
SELECT o_orderkey, CASE WHEN reason <> '' THEN 'issue' WHEN f = '' THEN 'unchanged' ELSE 'patch' END AS outcome, reason, CASE WHEN reason <> '' THEN '' ELSE f END AS fields FROM r""")
def delta_preflight(spark: SparkSession, sf: str) -> DataFrame:
    base = tables(spark, sf, "orders")[0].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    now = base.select("o_orderkey", (F.col("o_custkey") + F.when(k % 31 == 0, 1).otherwise(0)).alias("o_custkey"), F.concat("o_orderstatus", F.when(k % 7 == 0, "*").otherwise("")).alias("o_orderstatus"), F.when(k % 11 == 0, "x").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    found = delta.preflight(now, base.where(k % 13 != 0), "o_orderkey", ["o_custkey"], ["o_orderstatus", "o_orderpriority"])
    return found.select("o_orderkey", "outcome", "reason", F.array_join("fields", ",").alias("fields"))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 500000 ELSE c_custkey END AS id, c_custkey % 4 = 0 AS changed FROM customer")
def id_remap(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "customer")[0].select(F.col("c_custkey").alias("id"))
    return remapped(rows, rows.where("id % 4 = 0").select(F.col("id").alias("old"), (F.col("id") + 500000).alias("new")))


# --- scalars and imports ----------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name || ',' || p_type || ';' || upper(p_name), ';', ','), ','), lambda x: substr(trim(x), 1, 24)), lambda x: length(x) >= 2) AS l FROM part)
SELECT p_partkey, CASE WHEN len(l) >= 2 AND lower(l[1]) = lower(l[2]) THEN l[1] WHEN len(l) >= 3 AND lower(l[3]) IN (lower(l[1]), lower(l[2])) THEN l[1] || '|' || l[2] ELSE array_to_string(list_slice(l, 1, 3), '|') END AS tags FROM p""")
def normalize_tags(spark: SparkSession, sf: str) -> DataFrame:
    (p,) = tables(spark, sf, "part")
    return p.select("p_partkey", F.array_join(questions.tidy_tags(F.concat("p_name", F.lit(","), "p_type", F.lit(";"), F.upper("p_name"))), "|").alias("tags"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a1' WHEN 1 THEN 'FILL' WHEN 2 THEN 'true or false' WHEN 3 THEN 'choose all' WHEN 4 THEN '' ELSE 'A3' END AS k, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A,c' WHEN 2 THEN '' ELSE 'bb' END AS a FROM documents)
SELECT doc_id, CASE WHEN k = 'a1' THEN 'A1' WHEN k = 'FILL' THEN 'fill' WHEN k = 'A3' THEN 'A3' WHEN k = 'true or false' THEN 'judge' WHEN k = 'choose all' THEN 'multiple' WHEN a = 'A,c' THEN 'multiple' ELSE 'A1' END AS kind FROM x""")
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ["a1", "FILL", "true or false", "choose all", "", "A3"])), (i % 6 + 1).cast("int"))
    answer = F.element_at(F.array(*map(F.lit, ["A", "A,c", "", "bb"])), (i % 4 + 1).cast("int"))
    return tables(spark, sf, "documents")[0].select("doc_id", text.question_type(kind, answer, {"true": "judge", "all": "multiple"}).alias("kind"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/b;c' ELSE '' END AS blanks FROM benchmark")
def fill_answers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit('[["a"],[" "]]'), F.lit('[["a "," b"],["c",""]]'), F.lit("no json")), (F.col("item_id") % 3 + 1).cast("int"))
    blanks = text.fill_answers(raw)
    return tables(spark, sf, "benchmark")[0].select("item_id", F.array_join(F.transform(blanks, lambda b: F.array_join(b, "/")), ";").alias("blanks"))


@query("""SELECT item_id, '### analysis' || chr(10) || chr(10) || '**T**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '- x' || chr(10) || '- y' || chr(10) || chr(10) || '### pitfalls' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' AS markdown FROM benchmark""")
def blocks_markdown(spark: SparkSession, sf: str) -> DataFrame:
    texts = lambda *x: F.array(*map(F.lit, x))
    block = lambda s, t, title, body, items, columns, rows: F.struct(F.lit(s).alias("section"), F.lit(t).alias("type"), F.lit(title).alias("title"), body.alias("text"), items.alias("items"), columns.alias("columns"), rows.alias("rows"))
    none, no_rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    made = F.array(
        block("analysis", "paragraph", "T", F.col("text"), none, none, no_rows),
        block("analysis", "list", "", F.lit(""), texts("x", "y"), none, no_rows),
        block("pitfalls", "table", "", F.lit(""), none, texts("a", "b"), F.array(texts("1", "2"))),
    )
    return tables(spark, sf, "benchmark")[0].select("item_id", questions.markdown(made).alias("markdown"))


@query(r"SELECT item_id, 'one=' || trim(text) || ';two=end' AS sections FROM benchmark WHERE NOT contains(text, '### ')")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = questions.from_markdown(F.concat(F.lit("lead\n### one\n"), "text", F.lit("\n### two\nend\n")))
    rows = tables(spark, sf, "benchmark")[0].where(~F.contains("text", F.lit("### ")))
    return rows.select("item_id", F.array_join(F.transform(found, lambda b: F.concat(b["section"], F.lit("="), b["text"])), ";").alias("sections"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br */?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '^[ \t\n\f\r]+', ''), '[ \t\n\f\r]+$', '')) AS text_md5 FROM pages")
def html_plain(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "pages")[0].select("page_id", F.md5(text.plain(F.col("html"))).alias("text_md5"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '\$([0-9]+)\$', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text_md5 FROM pages")
def ocr_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(F.lit("\\text{"), F.regexp_replace("html", "[{}]", ""), F.lit("}"))
    same = F.when(F.col("html").rlike("[{}]"), F.col("html")).otherwise(wrapped)
    return tables(spark, sf, "pages")[0].select("page_id", F.md5(text.latex_tidy(same)).alias("text_md5"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def conversation_last_field(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return tables(spark, sf, "conversations")[0].select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.md5("text")), True).over(by).alias("heading"))


@query("SELECT lang, doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 20 AS BIGINT) AS batch FROM documents")
def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return questions.batches(tables(spark, sf, "documents")[0].select("lang", "doc_id"), 20, "doc_id", ["lang"]).select("lang", "doc_id", long("batch"))


@query()
def model_stub(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.embedded(tables(spark, sf, "benchmark")[0], "text", models.hashed_embedder())
    return rows.select("item_id", F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"), "error")


@query("SELECT item_id, CAST(pos AS BIGINT) AS pos, CAST(pos + 1 AS BIGINT) AS number, 'what is ' || CAST(pos AS VARCHAR) AS question, CASE WHEN pos = 0 THEN 'B' END AS answer, CASE WHEN pos = 0 THEN '' ELSE 'no answer' END AS issue FROM benchmark CROSS JOIN (SELECT unnest([0, 1]) AS pos)")
def numbered_split(spark: SparkSession, sf: str) -> DataFrame:
    raw = "1. what is 0\nA. x\nB. y\nAnswer: B\n2. what is 1\nA. x\nB. y"
    found = questions.numbered(tables(spark, sf, "benchmark")[0].select(F.col("item_id").alias("id"), F.lit(raw).alias("text")))
    return found.select(F.col("id").alias("item_id"), long("at", "pos"), long("number"), "question", "answer", "issue")


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    options = F.when(i % 5 == 0, F.array(F.lit("A. one"))).otherwise(F.array(F.lit("A. one"), F.lit("B. two")))
    return tables(spark, sf, "benchmark")[0].select(
        F.when(i % 7 != 0, (i % 31).cast("string")).alias("id"), i.alias("item_id"), F.lit("s").alias("subject"), F.col("text").alias("question"), F.when(i % 3 == 0, "C").when(i % 3 == 1, "AB").otherwise("A").alias("answer"),
        F.when(i % 4 == 0, "multiple").when(i % 4 == 1, "odd").otherwise("A1").alias("type"), F.lit("easy").alias("difficulty"), options.alias("options"), F.array(*map(F.lit, "abcd")).alias("tags"), F.array().cast("array<string>").alias("knowledge_points"),
    )


@query("""WITH x AS (SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN CAST(item_id % 31 AS VARCHAR) END AS id, CASE item_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'AB' ELSE 'A' END AS a, CASE item_id % 4 WHEN 0 THEN 'multiple' WHEN 1 THEN 'odd' ELSE 'A1' END AS t, CASE WHEN item_id % 5 = 0 THEN 1 ELSE 2 END AS n FROM benchmark)
SELECT item_id, concat_ws('; ', CASE WHEN id IS NULL THEN 'missing id' END, 'too many tags', CASE WHEN t = 'odd' THEN 'unknown type' END, CASE WHEN t <> 'odd' AND n < 2 THEN 'fewer than two options' END, CASE WHEN t <> 'odd' AND (a = 'C' OR (a = 'AB' AND n < 2)) THEN 'answer outside options' END, CASE WHEN t = 'A1' AND a = 'AB' THEN 'several answers' END, CASE WHEN id IS NOT NULL AND count(*) OVER (PARTITION BY id) > 1 THEN 'repeated id' END) AS errors FROM x""")
def normalize_question(spark: SparkSession, sf: str) -> DataFrame:
    return questions.validated(drafts(spark, sf)).select("item_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT item_id, item_id % 2 = 0 AS repaired, CASE WHEN item_id % 2 = 0 THEN 'what fits' ELSE 'what fits' END AS question, CASE WHEN item_id % 2 = 0 THEN 'A. one|B. two|C. three' ELSE 'A. one|B. two' END AS options FROM benchmark")
def recover_option(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    rows = tables(spark, sf, "benchmark")[0].select("item_id", F.when(i % 2 == 0, "what fits C. three").otherwise("what fits").alias("question"), F.array(F.lit("A. one"), F.lit("B. two")).alias("options"))
    return questions.recovered(rows).select("item_id", "repaired", "question", F.array_join("options", "|").alias("options"))


@query("SELECT c_custkey, trim(c_name) AS question, CASE WHEN c_custkey % 2 = 0 THEN 'given' ELSE c_mktsegment END AS subject, 'A. ' || c_mktsegment AS options FROM customer WHERE c_custkey % 9 <> 0")
def mapped_sheet(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf, "customer")[0]
    gone = F.col("c_custkey") % 9 == 0
    sheet = c.select(F.when(~gone, F.col("c_custkey")).alias("No"), F.when(~gone, F.col("c_name")).alias("Stem"), F.when(~gone & (F.col("c_custkey") % 2 != 0), F.col("c_mktsegment")).alias("Subject"), F.when(~gone, F.col("c_mktsegment")).alias("OptA"))
    found = mapped(sheet, {"id": "No", "question": "Stem", "subject": "Subject", "optionA": "OptA"}, ["optionA"], {"subject": "given"})
    return found.where("id IS NOT NULL").select(long(F.col("id"), "c_custkey"), "question", "subject", F.array_join("options", "|").alias("options"))


@query("SELECT item_id, 'case' || chr(10) || trim(text) || chr(10) || 'A. one' || chr(10) || 'B. two' AS prompt FROM benchmark WHERE trim(text) <> ''")
def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "benchmark")[0].where(F.trim("text") != "").select("item_id", F.lit("case ").alias("case_info"), F.col("text").alias("question"), F.array(F.lit("A. one"), F.lit("B. two")).alias("options"))
    return rows.select("item_id", questions.prompt().alias("prompt"))


@query("SELECT item_id, CAST(len(list_distinct(l)) AS BIGINT) AS n_bigrams FROM (SELECT item_id, CASE WHEN length(k) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_transform(generate_series(1, length(k) - 1), lambda i: substr(k, CAST(i AS INT), 2)) END AS l FROM (SELECT item_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z一-鿿]+', '', 'g') AS k FROM benchmark))")
def char_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "benchmark")[0].select("item_id", long(F.size(text.bigrams(F.col("text"))), "n_bigrams"))


@query(r"SELECT page_id, url, md5(substr(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), 1, 32767)) AS cell_md5 FROM pages")
def sheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells(tables(spark, sf, "pages")[0]).select("page_id", "url", F.md5("html").alias("cell_md5"))


@query("WITH " + TAGGED + " SELECT a.set_id, a.subject, a.k AS source, b.k AS target FROM cat a JOIN cat b ON a.set_id = b.set_id AND a.subject = b.subject AND a.k <> b.k AND b.status = 'active'")
def tag_merge_targets(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = tags.synced(tagged(spark, sf))
    return tags.merge_targets(catalog)


@query(f"SELECT question_id, true AS changed, array_to_string(list_slice(list_distinct_in_order, 1, 3), ',') AS tags, suggested FROM (SELECT question_id, [tags[1], tags[2], 'gamma'] AS list_distinct_in_order, 'ALPHA' AS suggested FROM ({CASES}))")
def tag_activate(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(tags.renamed(cases(spark, sf), "Gamma", " gamma ", True, 3))

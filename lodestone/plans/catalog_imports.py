"""The catalogue: specialty sheets, folders of mixed files, page references in prose, chunks within pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, exchange, pages
from ..sources import dispatch, specialty
from ..sources.readers import tables
from .catalog import long, query
from .catalog_commits import folder
from .catalog_exchange import SCHEMA, exchanged

# --- imports ----------------------------------------------------------------------------------------------------------


@query(r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, trim(regexp_replace(coalesce(text, ''), '[^\x01-\x7E]', '', 'g'), E' \t\n\r\f' || chr(11)) AS q, CASE doc_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'AB' WHEN 2 THEN '' ELSE 'A' END AS answer FROM documents),
h AS (SELECT *, substr(sha1('["药理学",' || to_json(lang) || ',' || to_json(q) || ',["A. x","B. y"],' || to_json(answer) || ']'), 1, 16) AS digest FROM d)
SELECT doc_id, 'latin1-gbk' AS codec, '药理学' AS subject, answer, CASE WHEN length(answer) > 1 THEN 'multiple' ELSE 'A1' END AS type, CAST((answer = '')::INT + (doc_id % 7 = 0)::INT AS BIGINT) AS n_issues, digest, row_number() OVER (PARTITION BY lang, digest ORDER BY doc_id) AS occurrence, count(*) OVER (PARTITION BY lang, digest) AS n_same FROM h""")
def specialty_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rows of wrongly decoded sheets, one for each language: headers and subjects are repaired, all rows kept."""
    wrong = lambda x: x.encode("gbk").decode("latin-1")
    i = F.col("doc_id")
    question = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x7E]", "")
    answer = F.element_at(F.array(F.lit("b."), F.lit("B、A,B".replace("、", "/")), F.lit(" "), F.lit("A")), (i % 4 + 1).cast("int"))
    cells = F.array(F.lit(wrong("药理学")), F.coalesce("lang", F.lit("")), question, F.lit("x"), F.lit("y"), F.lit(None), F.lit("nan"), F.lit(""), answer, F.col("source"), F.when(i % 7 == 0, "z"))
    docs = tables(spark, sf, "documents")[0]
    body = docs.select(F.coalesce("lang", F.lit("")).alias("path"), F.lit("s").alias("sheet"), (i + 2).cast("int").alias("row"), cells.alias("cells"))
    names = [wrong(x) for x in ("学科", "章节", "题干")] + list("ABCDE") + [wrong("答案"), wrong("解析"), "F"]
    heads = docs.select(F.coalesce("lang", F.lit("")).alias("path")).distinct().select("path", F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.array(*map(F.lit, names)).alias("cells"))
    found = specialty.flat_questions(heads.union(body))
    return found.select(long(F.col("row") - 2, "doc_id"), "codec", "subject", "answer", "type", long(F.size("issues"), "n_issues"), "digest", long("occurrence"), long("n_same"))


@query("""SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS question_md5, 'question' AS field FROM benchmark WHERE text <> '' UNION ALL SELECT CAST(doc_id AS VARCHAR), md5(text), 'stem' FROM documents WHERE text <> ''""")
def mixed_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder that holds exported envelopes, their mapping and history, and documents as JSON lines, read in one job."""
    path = folder(spark, "mixed")
    exchange.question_export(exchanged(spark, sf), path, "sets", SCHEMA, "", "test", "2026-01-01T00:00:00Z")
    tables(spark, sf, "documents")[0].select(F.col("doc_id").alias("id"), F.col("text").alias("stem"), "lang").write.json(f"{path}/rows")
    found = dispatch.as_questions(dispatch.folder_records(spark, path), {"id": ["id"], "question": ["question"], "stem": ["stem"]})
    text = F.coalesce("question", "stem")
    return found.where(text.isNotNull() | (F.col("error") != "")).select("id", F.md5(text).alias("question_md5"), F.when(F.col("question").isNotNull(), "question").otherwise("stem").alias("field"))


# --- pages ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5('第5页 ' || coalesce(text, '') || ' 第3页，第9页') AS prose_md5, '5,3,-' AS pages, doc_id % 3 <> 0 AS changed FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, md5('第3页 ' || coalesce(text, '') || ' 第5页，第9页'), '3,5,9', false FROM documents WHERE doc_id % 3 = 0""")
def swapped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A library's new offset swaps two pages of its evidence, in the prose too, and leaves a page without a number."""
    item = lambda p, q: F.struct(F.when(F.col("doc_id") % 3 != 0, "own").otherwise("other").alias("source_path"), F.lit(p).alias("pdf_page"), F.lit(q).alias("source_page"))
    rows = tables(spark, sf, "documents")[0].select("doc_id", F.concat(F.lit("第3页 "), F.coalesce("text", F.lit("")), F.lit(" 第5页，第9页")).alias("explanation"), F.array(item(14, 3), item(12, 5), item(4, 9)).alias("evidence"))
    found = pages.offset_applied(rows, F.lit(9), F.array(F.lit("own")))
    return found.select("doc_id", F.md5("explanation").alias("prose_md5"), F.array_join(F.transform("evidence", lambda e: F.coalesce(e["source_page"].cast("string"), F.lit("-"))), ",").alias("pages"), "changed")


PAGE = 3_000


@query(rf"""WITH p AS (SELECT doc_id, i AS page, substr(text, CAST(i * {PAGE} + 1 AS INT), {PAGE}) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil(length(text) / {PAGE}.0) AS INT) - 1))) AS i FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM p),"""
r"""
k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^\|.*\|$') THEN 'table' WHEN regexp_matches(line, '^\$\$|^\\\[') THEN 'formula' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM l),
m AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN regexp_replace(line, '^#+ ', '') END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title, lag(kind) OVER (PARTITION BY doc_id, page ORDER BY i) AS prev FROM k),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> kind OR kind IN ('formula', 'heading') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM m),
b AS (SELECT doc_id, page, block, kind, title, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE kind NOT IN ('blank', 'heading') GROUP BY ALL),
r AS (SELECT *, lag(kind) OVER w AS before, lag(title) OVER w AS above FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY block)),
s AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND before = 'paragraph' AND above IS NOT DISTINCT FROM title THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r),
g AS (SELECT doc_id, page, run, kind, title, string_agg(text, chr(10) || chr(10) ORDER BY block) AS text FROM s GROUP BY ALL),
c AS (SELECT doc_id, page, run, kind, title, i, regexp_replace(regexp_replace(substr(text, CAST(i * 450 + 1 AS INT), 500), '^[ \t\n\f\r]+', ''), '[ \t\n\f\r]+$', '') AS chunk_text FROM (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 500) / 450.0) AS INT)))) AS i FROM g))
SELECT doc_id, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY doc_id, page ORDER BY run, i) - 1 AS chunk_index, kind, title, md5(chunk_text) AS text_md5 FROM c WHERE chunk_text <> ''""")
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of documents paged by length: within pages, under headings, in windows where a run is long."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("text") / PAGE).cast("int") - 1))
    paged = tables(spark, sf, "documents")[0].where("text IS NOT NULL").select("doc_id", F.posexplode(F.transform(at, lambda i: F.substring(F.col("text"), i * PAGE + 1, F.lit(PAGE)))).alias("page", "text"))
    return chunking.page_chunks(paged).select("doc_id", long("page"), long("chunk_index"), "kind", "title", F.md5("chunk_text").alias("text_md5"))

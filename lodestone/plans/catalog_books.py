"""The catalogue: workbooks of six sheets, whole rows in form, edits of cells, blocks, issues and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editing, workbook
from ..sources.readers import tables
from ..store import kept
from .catalog import long, query
from .catalog_exchange import SCHEMA

STRIPPED = r"regexp_replace(regexp_replace({}, '^[ \t\n\f\r]+', ''), '[ \t\n\f\r]+$', '')"
PLAIN = STRIPPED.format(r"regexp_replace(regexp_replace(coalesce(text, ''), '(?i)<br */?>', chr(10), 'g'), '<[^>]*>', '', 'g')")
LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIPPED.format('x')}), lambda x: x <> '')"


def block(kind: str, text=None, items=None, columns=None, rows=None):
    null, words = F.lit(None), lambda w: F.array(*w) if w else F.lit(None)
    return F.struct(F.lit("").alias("blockId"), F.lit("analysis").alias("section"), F.lit(kind).alias("type"), F.lit("").alias("title"), (null if text is None else text).alias("text"), null.alias("tone"), words(items).alias("items"), words(columns).alias("columns"), (F.array(words(rows)) if rows else null).alias("rows")).cast(workbook.BLOCK)


# --- six sheets -------------------------------------------------------------------------------------------------------


@query(rf"""WITH d AS (SELECT *, substr({PLAIN}, 1, 4000) AS p FROM documents)
SELECT doc_id, md5(substr(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), 1, 32767)) AS question_md5, CASE WHEN p <> '' THEN 'paragraph,' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'table,' ELSE '' END || 'list' AS kinds,
md5({STRIPPED.format('p')}) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') || ',' || doc_id END AS cells, 'a,' || doc_id AS items, nullif(doc_id % 50, 0) :: BIGINT AS page, coalesce(source, '') AS book, 'h1,h2' AS highlights, lang, 'A. x|C. z' AS options, CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE '' END AS grade, true AS numbered FROM d""")
def six_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as questions in form, cut into the six sheets and put together again from their rows."""
    i, ident, source = F.col("doc_id"), F.col("doc_id").cast("string"), F.coalesce("source", F.lit(""))
    blocks = F.filter(F.array(block("paragraph", F.col("text")), F.when(i % 2 == 0, block("table", columns=[F.lit("a"), F.lit("b")], rows=[source, ident])), block("list", items=[F.lit("a"), F.lit(" "), ident])), lambda b: b.isNotNull())
    item = F.struct(source.alias("textbook"), F.lit("").alias("version"), F.lit("").alias("fileName"), (i % 50).cast("int").alias("sourcePage"), F.lit(None).cast("int").alias("pdfPage"), F.lit("q").alias("quote"), F.lit("").alias("excerpt"), F.lit("").alias("contextSummary"), F.array(F.lit("h1"), F.lit("h2")).alias("highlights"), F.array().cast("array<string>").alias("supportedClues"), F.lit(0.5).alias("score"), F.lit("").alias("extractionMethod"))
    mode = F.from_json(F.when(i % 3 == 0, '{"mode":"textbook_reasoning"}').otherwise("{}"), workbook.META)
    docs = tables(spark, sf, "documents")[0].select(ident.alias("id"), F.lit("school").alias("bank"), F.col("text").alias("question"), F.array(F.lit("A. x"), F.lit(""), F.lit("C. z")).alias("options"), blocks.alias("explanationBlocks"), F.array(item).alias("evidence"), mode.alias("explanationMeta"), "lang")
    found = workbook.nested(workbook.opened(workbook.as_rows(workbook.flat(kept(workbook.normal(docs)), SCHEMA, source="test"), "book")), SCHEMA)
    one = lambda kind: F.get(F.filter("explanationBlocks", lambda b: b["type"] == kind), F.lit(0))
    e = F.get("evidence", F.lit(0))
    numbered = F.size(F.array_distinct(F.transform("explanationBlocks", lambda b: b["blockId"]))) == F.size("explanationBlocks")
    return found.select(
        long("id", "doc_id"), F.md5("question").alias("question_md5"), F.array_join(F.transform("explanationBlocks", lambda b: b["type"]), ",").alias("kinds"), F.md5(F.coalesce(one("paragraph")["text"], F.lit(""))).alias("text_md5"), F.array_join(F.get(one("table")["rows"], F.lit(0)), ",").alias("cells"), F.array_join(one("list")["items"], ",").alias("items"),
        long(e["sourcePage"], "page"), e["textbook"].alias("book"), F.array_join(e["highlights"], ",").alias("highlights"), F.col("extensions")["lang"].alias("lang"), F.array_join("options", "|").alias("options"), F.col("explanationMeta.evidenceGrade").alias("grade"), numbered.alias("numbered"),
    )


@query(rf"""WITH d AS (SELECT *, substr({PLAIN}, 1, 4000) AS p, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS edited FROM documents d)
SELECT doc_id, edited, 'status ' || doc_id AS review_status, CASE WHEN edited THEN 'new' ELSE 'old' END AS mnemonic, CASE WHEN edited THEN 'tag,' || coalesce(lang, 'none') ELSE 'own' END AS tags, md5(CASE WHEN edited AND p <> '' THEN '### 考点解析' || chr(10) || chr(10) || p WHEN edited THEN '' ELSE '### 考点解析' || chr(10) || chr(10) || 'before' END) AS explanation_md5 FROM d""")
def exchange_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents get new blocks, tags and mnemonics; texts are written anew from blocks, and the workflow stays."""
    docs, labels = tables(spark, sf, "documents", "labels")
    ident = F.col("doc_id").cast("string").alias("id")
    rows = docs.select(ident, F.lit("old").alias("mnemonic"), F.array(F.lit("own")).alias("tags"), F.lit("before").alias("explanation"), F.concat(F.lit("status "), "doc_id").alias("review_status"))
    edits = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(ident, F.array(block("paragraph", F.col("text"))).alias("explanationBlocks"), F.array(F.lit("tag"), F.coalesce("lang", F.lit("none")), F.lit("TAG")).alias("tags"), F.lit(" new ").alias("mnemonic"))
    found = workbook.exchange_edited(rows, edits, keep=("review_status",))
    return found.select(long("id", "doc_id"), "edited", "review_status", "mnemonic", F.array_join("tags", ",").alias("tags"), F.md5("explanation").alias("explanation_md5"))


# --- edits ------------------------------------------------------------------------------------------------------------


@query(rf"""WITH e AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN lang ELSE text END AS value, CASE WHEN doc_id % 5 = 0 THEN 'judge' WHEN doc_id % 3 = 0 THEN 'fill' ELSE 'A1' END AS kind FROM documents),
o AS (SELECT *, CASE WHEN value IS NOT NULL THEN list_filter(list_transform(string_split_regex(value, '[|\n]+'), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') END AS options FROM e)
SELECT doc_id, kind, len(options) AS n_options, md5(array_to_string(options, '|')) AS options_md5, CASE WHEN kind = 'fill' THEN '[["a","b"]]' ELSE ' [["a", " b "]]' END AS answer, CAST((doc_id % 2 = 0 AND lang IS NULL)::INT + (text IS NULL)::INT + (doc_id % 5 = 1)::INT AS BIGINT) AS n_refused FROM o""")
def edited_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of options, answers and types, the last of a cell; what is not allowed, or has no value, is refused."""
    i, ident = F.col("doc_id"), F.col("doc_id").cast("string").alias("id")
    docs = tables(spark, sf, "documents")[0]
    rows = docs.select(ident, F.when(i % 3 == 0, "fill").otherwise("A1").alias("type"), F.lit(None).cast("array<string>").alias("options"), F.lit("x").alias("answer"))
    edit = lambda field, value, at: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(at).alias("at"))
    made = F.array(edit("options", F.col("text"), 1), F.when(i % 2 == 0, edit("options", F.col("lang"), 2)), edit("answer", F.lit(' [["a", " b "]]'), 1), F.when(i % 5 == 0, edit("type", F.lit(" judge "), 1)).when(i % 5 == 1, edit("type", F.lit("odd"), 1)))
    edits = docs.select(ident, F.explode(F.array_compact(made)).alias("e")).select("id", "e.*")
    done, refused = editing.cells_set(rows, edits, ["type", "options", "answer"])
    n = refused.groupBy("id").agg(F.count("*").alias("n"))
    return done.join(n, "id", "left").select(long("id", "doc_id"), F.col("type").alias("kind"), long(F.when(F.col("options").isNotNull(), F.size("options")), "n_options"), F.md5(F.array_join("options", "|")).alias("options_md5"), "answer", F.coalesce("n", F.lit(0)).cast("long").alias("n_refused"))


@query(rf"""WITH l AS (SELECT doc_id, {LINES} AS lines FROM documents),
r AS (SELECT doc_id, CASE WHEN lines = [] THEN [''] ELSE lines END AS items, CASE WHEN lines = [] THEN [','] ELSE list_transform(lines, lambda x: CASE WHEN len(string_split_regex(x, '[|\t]')) < 2 THEN x || ',' ELSE array_to_string(string_split_regex(x, '[|\t]'), ',') END) END AS rows FROM l)
SELECT doc_id, len(items) AS n_items, md5(array_to_string(items, '|')) AS items_md5, md5(array_to_string(rows, ';')) AS rows_md5, md5(array_to_string(items, chr(10))) AS text_md5, CASE WHEN len(rows) > 20 THEN 'rows,items' ELSE '' END AS limits FROM r""")
def converted_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as blocks that become lists and tables, and texts again; what then breaks the format's limits."""
    docs = tables(spark, sf, "documents")[0].select("doc_id", editing.converted(block("paragraph", F.coalesce("text", F.lit(""))), "list").alias("l"), editing.converted(block("paragraph", F.coalesce("text", F.lit(""))), "table").alias("t"))
    rows = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";")
    return docs.select("doc_id", long(F.size("l.items"), "n_items"), F.md5(F.array_join("l.items", "|")).alias("items_md5"), F.md5(rows).alias("rows_md5"), F.md5(editing.converted(F.col("l"), "paragraph")["text"]).alias("text_md5"), F.array_join(editing.block_limits(F.array("l", "t")), ",").alias("limits"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE '[]' END AS open, CASE WHEN doc_id % 3 = 0 THEN '[' || coalesce('"' || lang || '"', 'null') || ']' END AS resolved, CASE WHEN doc_id % 3 = 0 THEN 'now' END AS checked, coalesce(source, '') AS kept FROM documents""")
def resolved_issues(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    issues = F.when(i % 3 == 0, F.to_json(F.array("lang"))).when(i % 3 == 1, "[]")
    held = F.map_filter(F.create_map(F.lit("importIssues"), issues, F.lit("source"), F.coalesce("source", F.lit(""))), lambda k, v: v.isNotNull())
    found = editing.issues_resolved(tables(spark, sf, "documents")[0].select("doc_id", held.alias("extensions")), F.lit(True), F.lit("now"))
    at = lambda k, name: F.col("extensions")[k].alias(name)
    return found.select("doc_id", at("importIssues", "open"), at("resolvedImportIssues", "resolved"), at("sourceCheckedAt", "checked"), at("source", "kept"))


@query("""SELECT o_orderkey AS saved, o_custkey % 97 AS library_id FROM orders WHERE o_custkey % 97 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def usable_selection(spark: SparkSession, sf: str) -> DataFrame:
    o, s = tables(spark, sf, "orders", "supplier")
    return editing.still_usable(o.select(long("o_orderkey", "saved"), long(F.col("o_custkey") % 97, "library_id")), s.where("s_acctbal > 0").select(long("s_suppkey", "library_id")))


@query("""SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL""")
def selected_ids(spark: SparkSession, sf: str) -> DataFrame:
    c, o = tables(spark, sf, "customer", "orders")
    return editing.selected_too(c.where("c_acctbal < 0").select(long("c_custkey", "id")), o.where("o_orderstatus = 'F'").select(long("o_custkey", "id")))

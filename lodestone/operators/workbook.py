"""Questions of the exchange format as whole rows in form, and as workbooks of six sheets, both ways.

A row has the columns FIELDS; missing ones are null. Null lists count as empty, null texts as blank. Sheets are tables with
a row of cells each, so a workbook is never larger than what its format holds; folders of workbooks are read in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import nfkc
from ..functions.cleaners import filled, first_by, study_points
from ..functions.text import clean, fill_answers, key, one_line, plain, strip
from ..sources.office import headed
from ..sources.writers import CELL, CONTROL
from ..store import kept as stored
from ..store import near
from .exchange import catalog_entries, meta
from .formats import blocks as tidy_blocks
from .questions import tidy_points, tidy_tags
from .sets import card_meta

BLOCK = "struct<blockId:string,section:string,type:string,title:string,text:string,tone:string,items:array<string>,columns:array<string>,rows:array<array<string>>>"
EVIDENCE = "struct<textbook:string,version:string,fileName:string,sourcePage:int,pdfPage:int,quote:string,excerpt:string,contextSummary:string,highlights:array<string>,supportedClues:array<string>,score:double,extractionMethod:string>"
CARD = "struct<title:string,content:string,memoryCue:string,contrast:string>"
META = "struct<mode:string,model:string,evidenceGrade:string,reasoningType:string,thinking:boolean,modelFallback:boolean,complexityScore:int,routeReasons:array<string>,requestCount:int,score:double,generatedAt:string,reviewedAt:string,reviewWarnings:array<string>>"
#: columns of a question; nested fields keep the order named here
FIELDS = dict.fromkeys("id bank questionSource type subject system difficulty caseInfo question answer year sourceType explanation briefExplanation mnemonic".split(), "string") | {
    "options": "array<string>", "knowledgePoints": "array<string>", "tags": "array<string>", "suggestedTags": "array<string>",
    "studyPoints": "array<struct<title:string,body:string>>", "memoryCards": f"array<{CARD}>",
    "memoryCardMeta": "struct<schemaVersion:int,generator:string,generatedAt:string>", "explanationBlocks": f"array<{BLOCK}>",
    "evidence": f"array<{EVIDENCE}>", "explanationMeta": META, "extensions": "map<string,string>",
}

# fixed values: headings of sections, marks of callouts, and names of sheets and columns of the format
TITLES = {"analysis": "考点解析", "answerBasis": "正确答案依据", "pitfalls": "易错点提示", "clinicalNotes": "临床与操作要点"}
SECTION_WORDS = {"answerBasis": "答案|依据", "pitfalls": "易错|辨析", "clinicalNotes": "临床|操作|关键"}
MARKS = {"warning": "注意：", "important": "重点："}
ABOUT, QUESTIONS, BLOCKS, SOURCES, CARDS, TAGS = "_meta", "题目", "解析区块", "教材证据", "背诵知识卡", "标签目录"
HEADS = {
    ABOUT: "key value",
    QUESTIONS: "ID 题库 题库来源 题型 学科 章节 难度 病例背景 题干 选项A 选项B 选项C 选项D 选项E 答案 知识点1 知识点2 知识点3 题目标签1 题目标签2 题目标签3 候选标签1 候选标签2 候选标签3 一句话简析 记忆口诀 年份 解析纯文本 来源类型 证据等级 推理类型 考点JSON 扩展字段JSON",
    BLOCKS: "题目ID 区块序号 区块ID 所属部分 类型 标题 提示样式 行序号 正文 列名1 单元格1 列名2 单元格2 列名3 单元格3 列名4 单元格4 列名5 单元格5",
    SOURCES: "题目ID 序号 教材名称 版本 文件名 课本页码 PDF页码 相似度 提取方式 关键原句 重点片段 支持线索 AI整理上下文 教材原文",
    CARDS: "题目ID 序号 标题 独立背诵正文 记忆提示 对比辨析 生成器 生成时间 格式版本",
    TAGS: "学科 标签 别名 状态 使用次数 合并至",
}
UNREADABLE = "扩展字段JSON无法解析"

none = lambda kind: F.array().cast(kind)
blank = lambda c: F.coalesce(c, F.lit(""))


# --- whole rows in form -----------------------------------------------------------------------------------------------


def evidence_in_form(items: Column) -> Column:
    """The first ten items with bounded texts and lists; pages that are not above zero are null."""
    some = lambda c: F.slice(F.filter(F.transform(F.coalesce(c, none("array<string>")), lambda x: one_line(x, 120)), lambda x: blank(x) != ""), 1, 8)
    line = lambda c, n: blank(one_line(c, n))
    named = lambda e: F.coalesce(F.nullif(line(e["textbook"], 120), F.lit("")), line(e["fileName"], 120))
    one = lambda e: F.struct(
        named(e).alias("textbook"), line(e["version"], 60).alias("version"), line(e["fileName"], 180).alias("fileName"),
        F.when(e["sourcePage"] > 0, e["sourcePage"]).alias("sourcePage"), F.when(e["pdfPage"] > 0, e["pdfPage"]).alias("pdfPage"),
        blank(clean(e["quote"], 2000)).alias("quote"), blank(clean(e["excerpt"], 500)).alias("excerpt"), blank(clean(e["contextSummary"], 500)).alias("contextSummary"),
        some(e["highlights"]).alias("highlights"), some(e["supportedClues"]).alias("supportedClues"), F.coalesce(e["score"], F.lit(0.0)).alias("score"),
        F.coalesce(F.nullif(line(e["extractionMethod"], 20), F.lit("")), F.lit("text")).alias("extractionMethod"),
    )
    return F.transform(F.filter(F.slice(F.coalesce(items, none(f"array<{EVIDENCE}>")), 1, 10), lambda e: e.isNotNull()), one)


def blocks_of_text(text: Column) -> Column:
    """A text as blocks: one for each level-3 heading, told by its words; lists where every line of several has a mark."""
    whole = plain(blank(text))
    parts = F.filter(F.transform(F.split(whole, r"(?m)(?=^###\s)"), strip), lambda p: p != "")

    def one(p: Column, i: Column) -> Column:
        heading = p.rlike(r"^###\s*[^\n]")
        title = F.when(heading, one_line(F.regexp_extract(p, r"^###\s*([^\n]+)", 1), 40)).when(i == 0, TITLES["analysis"]).otherwise("")
        body = F.when(heading, strip(F.regexp_replace(p, r"^###\s*[^\n]+\n?", ""))).otherwise(p)
        section = F.lit("analysis")
        for name, words in reversed(SECTION_WORDS.items()):
            section = F.when(title.rlike(words), name).otherwise(section)
        lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")
        listed = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(r"^[-*]\s"))
        items = F.when(listed, F.transform(lines, lambda x: F.regexp_replace(x, r"^[-*]\s+", "")))
        null = F.lit(None)
        return F.struct(F.lit("").alias("blockId"), section.alias("section"), F.when(listed, "list").otherwise("paragraph").alias("type"), title.alias("title"), F.when(~listed, body).alias("text"), F.lit("").alias("tone"), items.alias("items"), null.cast("array<string>").alias("columns"), null.cast("array<array<string>>").alias("rows"))

    return F.transform(F.slice(parts, 1, 12), one)


def with_own_ids(made: Column, given: Column) -> Column:
    """Blocks in form with the ids that the given ones have, if none of those went."""
    own = lambda i: F.when((F.size(made) == F.size(given)) & filled(F.get(given, i)["blockId"]), F.get(given, i)["blockId"])
    return F.transform(made, lambda b, i: b.withField("blockId", F.coalesce(own(i), b["blockId"])))


def shown(found: Column, evidence: Column) -> Column:
    """Blocks in form as markdown under their sections' headings, and a list of the books behind them."""
    titles = F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))
    before = F.concat(none("array<string>"), F.array(F.lit("")), F.transform(found, lambda b: b["section"]))
    safe = lambda x: F.replace(F.replace(clean(blank(x), 500), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def one(b: Column, i: Column) -> Column:
        head = F.when(F.get(before, i) != b["section"], F.concat(F.lit("### "), titles[b["section"]]))
        title = F.when((b["title"] != "") & (b["title"] != titles[b["section"]]), F.concat(F.lit("**"), b["title"], F.lit("**")))
        table = F.concat_ws("\n", line(F.transform(b["columns"], safe)), line(F.transform(b["columns"], lambda c: F.lit("---"))), F.array_join(F.transform(b["rows"], lambda r: line(F.transform(r, safe))), "\n"))
        mark = F.lit("")
        for tone, word in MARKS.items():
            mark = F.when(b["tone"] == tone, word).otherwise(mark)
        body = F.when(b["type"] == "list", F.array_join(F.transform(b["items"], lambda x: F.concat(F.lit("- "), x)), "\n")).when(b["type"] == "table", table).when(b["type"] == "callout", F.concat(F.lit("> "), mark, b["text"])).otherwise(b["text"])
        return F.concat_ws("\n\n", head, title, body)

    def book(e: Column) -> Column:
        name = F.coalesce(F.nullif(e["textbook"], F.lit("")), F.nullif(e["fileName"], F.lit("")), F.lit("教材"))
        version = F.when(e["version"] != "", F.concat(F.lit("（"), e["version"], F.lit("）"))).otherwise("")
        page = F.when(e["sourcePage"].isNull(), "课本前置页").otherwise(F.concat(F.lit("课本第"), e["sourcePage"].cast("string"), F.lit("页")))
        return F.concat(F.lit("- 《"), name, F.lit("》"), version, F.lit(" · "), page)

    books = F.when(F.size(evidence) > 0, F.concat(F.lit("### 教材出处\n\n"), F.array_join(F.transform(evidence, book), "\n")))
    return F.concat_ws("\n\n", F.nullif(F.array_join(F.transform(found, one), "\n\n"), F.lit("")), books)


def compared(text: Column) -> Column:
    """Letters and digits alone, whatever their case and width."""
    return F.regexp_replace(key(blank(text)), r"[^\p{L}\p{N}]+", "")


def cards_in_form(cards: Column, blocked: Column, most: int = 3) -> Column:
    """Cards with title and content whose compared() forms are none of the blocked, of equal titles the first, at most `most`."""
    tidy = F.transform(F.filter(F.coalesce(cards, none(f"array<{CARD}>")), lambda c: c.isNotNull()), lambda c: F.struct(blank(one_line(c["title"], 30)).alias("title"), blank(clean(c["content"], 500)).alias("content"), blank(one_line(c["memoryCue"], 160)).alias("memoryCue"), blank(clean(c["contrast"], 300)).alias("contrast")))
    kept = F.filter(tidy, lambda c: (c["title"] != "") & (c["content"] != "") & ~F.array_contains(blocked, compared(c["title"])) & ~F.array_contains(blocked, compared(c["content"])))
    return F.slice(first_by(kept, lambda a, b: compared(a["title"]) == compared(b["title"])), 1, most)


def normal(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Questions in form: the columns FIELDS, and `keep` as they are; all other columns that are not null become extensions,
    as text. Blocks come from the explanation where a row has none, and the explanation is written anew from the blocks. A
    row in form stays as it is."""
    others = [c for c in rows.columns if c not in FIELDS and c not in keep]
    extra = F.map_filter(F.create_map(*(x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string")))), lambda k, v: v.isNotNull()) if others else None
    fields = [(F.col(f"`{c}`").cast(k) if c in rows.columns else F.lit(None).cast(k)).alias(c) for c, k in FIELDS.items()]
    found = rows.select(*(F.col(f"`{c}`") for c in keep), *fields, *([extra.alias("_extra")] if others else []))
    own = F.coalesce("extensions", F.create_map().cast(FIELDS["extensions"]))
    given = F.filter(F.coalesce("explanationBlocks", none(FIELDS["explanationBlocks"])), lambda b: b.isNotNull())
    found = found.withColumns({
        "options": F.coalesce("options", none("array<string>")),
        "extensions": F.map_concat(F.map_filter(own, lambda k, v: ~k.isin(*others)), F.col("_extra")) if others else own,
        "explanationBlocks": F.when(F.size(given) > 0, given).otherwise(blocks_of_text(F.col("explanation"))),
        "evidence": evidence_in_form(F.col("evidence")),
    })
    found = found.withColumn("_made", tidy_blocks(F.col("explanationBlocks"))).withColumn("explanationBlocks", with_own_ids(F.col("_made"), F.col("explanationBlocks"))).drop("_made")
    line = lambda c, n: blank(one_line(F.col(c), n))
    joined = lambda c: F.array_join(F.coalesce(c, none("array<string>")), "、")
    m = F.col("explanationMeta")
    about = F.struct(
        m["mode"].alias("mode"), m["model"].alias("model"), m["evidenceGrade"].alias("evidence_grade"), m["reasoningType"].alias("reasoning_type"), m["thinking"].alias("thinking"), m["modelFallback"].alias("model_fallback"),
        m["complexityScore"].alias("complexity"), joined(m["routeReasons"]).alias("route_reasons"), m["requestCount"].alias("request_count"), m["score"].alias("score"), m["generatedAt"].alias("generated_at"), m["reviewedAt"].alias("reviewed_at"), joined(m["reviewWarnings"]).alias("warnings"),
    )
    found = found.withColumns({
        "answer": F.when(line("type", 20) == "fill", F.to_json(F.coalesce(fill_answers(F.col("answer")), none("array<array<string>>")))).otherwise(F.col("answer")),
        "questionSource": F.coalesce(nfkc(line("questionSource", 40)), F.lit("")),
        "explanation": shown(F.col("explanationBlocks"), F.col("evidence")),
        "briefExplanation": line("briefExplanation", 160), "mnemonic": blank(clean(F.col("mnemonic"), 1000)),
        "knowledgePoints": tidy_points(joined("knowledgePoints")), "tags": tidy_tags(joined("tags")), "suggestedTags": tidy_tags(joined("suggestedTags")),
        "studyPoints": study_points(F.coalesce("studyPoints", none(FIELDS["studyPoints"]))),
        "explanationMeta": meta(about).cast(META),
        "memoryCardMeta": F.when(F.size(F.coalesce("memoryCards", none(FIELDS["memoryCards"]))) > 0, card_meta(F.col("memoryCardMeta.schemaVersion"), F.col("memoryCardMeta.generator"), F.col("memoryCardMeta.generatedAt"))),
    })
    texts = F.flatten(F.transform("explanationBlocks", lambda b: F.concat(F.array(b["title"], b["text"]), b["items"], F.flatten(b["rows"]))))
    blocked = F.concat("knowledgePoints", "tags", "suggestedTags", F.array("briefExplanation", "explanation", "mnemonic"), F.flatten(F.transform("studyPoints", lambda p: F.array(p["title"], p["body"]))), texts)
    found = found.withColumn("_blocked", F.array_distinct(F.filter(F.transform(blocked, compared), lambda x: x != "")))
    return found.withColumn("memoryCards", cards_in_form(F.col("memoryCards"), F.col("_blocked"))).select(*keep, *FIELDS)


def exchange_edited(rows: DataFrame, edits: DataFrame, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """rows with the edited fields of the format (any of explanationBlocks, knowledgePoints, tags, suggestedTags, mnemonic,
    briefExplanation; one edit a key), brought into form again; `keep` holds the workflow's columns, which stay. Null fields
    of an edit leave a row's own; edits of unknown keys change nothing, and of several for a key the least counts."""
    fields = [c for c in ("explanationBlocks", "knowledgePoints", "tags", "suggestedTags", "mnemonic", "briefExplanation") if c in edits.columns]
    new = edits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*fields)).alias("_new"))
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    kept = joined.withColumn("_edited", F.col("_key").isNotNull()).withColumns({f: F.coalesce(F.col("_new")[f].cast(FIELDS[f]), F.col(f).cast(FIELDS[f]) if f in rows.columns else F.lit(None).cast(FIELDS[f])) for f in fields})
    return normal(kept.drop("_key", "_new"), (*keep, "_edited")).withColumnRenamed("_edited", "edited")


# --- six sheets -------------------------------------------------------------------------------------------------------


def flat(questions: DataFrame, schema: str, name: str = "", bank: str = "", source: str = "unknown", exported_at: str = "", tags: DataFrame | None = None) -> dict[str, DataFrame]:
    """Questions in form (see normal) as the six sheets, all cells text; see office.workbook_bytes() for the file. Catalogue
    rows (subject, label, aliases, status, usage, merged_into) make the last one."""
    text = lambda c: blank(F.substring(F.regexp_replace(c.cast("string"), CONTROL, ""), 1, CELL))
    sheet = lambda rows, head, cells: rows.select(*(text(c).alias(h) for h, c in zip(HEADS[head].split(), cells, strict=True)))
    q = questions
    col, three = F.col, lambda c: [F.get(c, F.lit(i)) for i in range(3)]
    many = lambda c: F.array_join(c, "、")
    option = lambda i: F.regexp_replace(one_line(F.get("options", F.lit(i)), CELL), r"^[A-E][.、．:]\s*", "")
    pairs = {"schema": F.lit(schema), "schemaVersion": F.lit("2"), "name": F.lit(name), "bank": F.coalesce(F.nullif(F.lit(bank), F.lit("")), col("own")), "source": F.lit(source), "exportedAt": F.lit(exported_at), "questionCount": col("n").cast("string")}
    counts = q.agg(F.count("*").alias("n"), F.min("bank").alias("own"))
    lines = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()))).alias("x")).select("x.*")
    out = {ABOUT: sheet(lines, ABOUT, [col("k"), col("v")])}
    out[QUESTIONS] = sheet(q, QUESTIONS, [
        *map(col, "id bank questionSource type subject system difficulty caseInfo question".split()), *map(option, range(5)), col("answer"), *three("knowledgePoints"), *three("tags"), *three("suggestedTags"),
        *map(col, "briefExplanation mnemonic year explanation sourceType explanationMeta.evidenceGrade explanationMeta.reasoningType".split()), F.to_json("studyPoints"), F.to_json("extensions"),
    ])
    b = q.select("id", F.posexplode("explanationBlocks").alias("at", "b"))
    nothing = F.array(F.array().cast("array<string>"))
    parts = F.when(col("b.type") == "table", col("b.rows")).when(col("b.type") == "list", F.transform("b.items", lambda x: F.array(x))).otherwise(nothing)
    b = b.select("id", "at", "b", F.posexplode(parts).alias("line", "cells"))
    body = F.when(col("b.type") == "list", F.get("cells", F.lit(0))).when(col("b.type") != "table", col("b.text"))
    table = col("b.type") == "table"
    grid = [c for i in range(5) for c in (F.get("b.columns", F.lit(i)), F.when(table, F.get("cells", F.lit(i))))]
    out[BLOCKS] = sheet(b, BLOCKS, [col("id"), col("at") + 1, col("b.blockId"), col("b.section"), col("b.type"), col("b.title"), col("b.tone"), col("line") + 1, body, *grid])
    e = q.select("id", F.posexplode("evidence").alias("at", "e"))
    out[SOURCES] = sheet(e, SOURCES, [col("id"), col("at") + 1, *(col(f"e.{f}") for f in "textbook version fileName sourcePage pdfPage score extractionMethod excerpt".split()), many("e.highlights"), many("e.supportedClues"), col("e.contextSummary"), col("e.quote")])
    c = q.select("id", "memoryCardMeta", F.posexplode("memoryCards").alias("at", "c"))
    out[CARDS] = sheet(c, CARDS, [col("id"), col("at") + 1, *(col(f"c.{f}") for f in "title content memoryCue contrast".split()), col("memoryCardMeta.generator"), col("memoryCardMeta.generatedAt"), col("memoryCardMeta.schemaVersion")])
    entries = catalog_entries(tags) if tags is not None else q.sparkSession.createDataFrame([], "subject string, label string, aliases array<string>, status string, usageCount long, mergedInto string")
    out[TAGS] = sheet(entries, TAGS, [col("subject"), col("label"), many("aliases"), col("status"), col("usageCount"), col("mergedInto")])
    return out


def as_rows(sheets: dict[str, DataFrame], path: str = "") -> DataFrame:
    """Sheets as rows of cells (path, sheet, row, cells, error), as office.workbooks() reads them; rows after a header are
    not numbered: sheets of the format number what has an order."""
    out = None
    for name, rows in sheets.items():
        head = F.array(*map(F.lit, rows.columns))
        body = rows.select(F.lit(path).alias("path"), F.lit(name).alias("sheet"), F.lit(2).alias("row"), F.array(*(F.col(f"`{c}`") for c in rows.columns)).alias("cells"), F.lit("").alias("error"))
        top = rows.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(name).alias("sheet"), F.lit(1).alias("row"), head.alias("cells"), F.lit("").alias("error"))
        out = top.union(body) if out is None else out.union(top).union(body)
    return out


def opened(rows: DataFrame) -> DataFrame:
    """path, sheet, row and `fields` of the format's sheets among the rows of workbooks (path, sheet, row, cells, error), read
    once and stored: all that follows joins these."""
    return stored(headed(rows.where(F.col("sheet").isin(*HEADS)), ["key", "ID", "题目ID", "标签"]))


def about(found: DataFrame, schema: str) -> DataFrame:
    """path, name, bank, source, exportedAt of the workbooks that are of the format: others, and those of another version, are not."""
    pairs = found.where(F.col("sheet") == ABOUT).select("path", F.col("fields")["key"].alias("k"), F.col("fields")["value"].alias("v"))
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    books = pairs.groupBy("path").agg(value("schema").alias("_schema"), value("schemaVersion").alias("_version"), *(blank(value(k)).alias(k) for k in ("name", "bank", "source", "exportedAt")))
    return books.where((F.col("_schema") == schema) & (F.col("_version").try_cast("double") == 2)).drop("_schema", "_version")


def nested(found: DataFrame, schema: str) -> DataFrame:
    """`path` and the questions in form of opened() workbooks, those that are of the format.

    A list or table is put together from its lines, in order; unreadable extensions become a warning. Cells that a number
    should fill and do not are null; rows without an id keep what has none either, but for cards.
    """
    mine = near(about(found, schema))
    held = lambda name: found.where(F.col("sheet") == name).join(mine, "path", "left_semi")
    at = lambda h: F.col("fields")[h]
    number = lambda h: at(h).try_cast("double").cast("int")
    ident = lambda h: blank(one_line(at(h), CELL)).alias("id")
    parted = lambda h: F.filter(F.split(blank(at(h)), "、"), lambda x: x != "")

    def gathered(found: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("row").alias("r"), value.alias("v"))))
        return found.groupBy("path", "id").agg(F.transform(ordered, lambda x: x["v"]).alias(name))

    b = held(BLOCKS).select("path", "row", ident("题目ID"), F.coalesce(number("区块序号"), F.lit(1)).alias("at"), F.coalesce(number("行序号"), F.lit(0)).alias("line"), "fields")
    b = b.groupBy("path", "id", "at").agg(F.min("row").alias("row"), F.sort_array(F.collect_list(F.struct("line", F.col("row").alias("r"), *(F.col("fields")[h].alias(h) for h in HEADS[BLOCKS].split()[2:])))).alias("lines"))
    first = F.get("lines", F.lit(0))
    columns = F.filter(F.array(*(blank(one_line(first[f"列名{i}"], 80)) for i in range(1, 6))), lambda x: x != "")
    kind = blank(one_line(first["类型"], 20))
    cells = F.transform("lines", lambda x: F.slice(F.array(*(blank(clean(x[f"单元格{i}"], 500)) for i in range(1, 6))), F.lit(1), F.greatest(F.lit(1), F.size(columns))))
    items = F.filter(F.transform("lines", lambda x: blank(one_line(x["正文"], 500))), lambda x: x != "")
    block = F.struct(first["区块ID"].alias("blockId"), first["所属部分"].alias("section"), kind.alias("type"), first["标题"].alias("title"), F.when(~kind.isin("list", "table"), clean(first["正文"], 4000)).alias("text"), first["提示样式"].alias("tone"), F.when(kind == "list", items).alias("items"), F.when(kind == "table", columns).alias("columns"), F.when(kind == "table", cells).alias("rows"))
    b = gathered(b, F.col("at"), block, "explanationBlocks")
    item = F.struct(at("教材名称").alias("textbook"), at("版本").alias("version"), at("文件名").alias("fileName"), number("课本页码").alias("sourcePage"), number("PDF页码").alias("pdfPage"), F.coalesce(F.nullif(at("教材原文"), F.lit("")), F.nullif(at("完整上下文"), F.lit("")), at("证据摘要")).alias("quote"), at("关键原句").alias("excerpt"), at("AI整理上下文").alias("contextSummary"), parted("重点片段").alias("highlights"), parted("支持线索").alias("supportedClues"), at("相似度").try_cast("double").alias("score"), at("提取方式").alias("extractionMethod"))
    e = gathered(held(SOURCES).select("path", "row", ident("题目ID"), "fields"), F.coalesce(number("序号"), F.lit(1)), item, "evidence")
    c = held(CARDS).select("path", "row", ident("题目ID"), "fields").where("id <> ''")
    card = F.struct(at("标题").alias("title"), at("独立背诵正文").alias("content"), at("记忆提示").alias("memoryCue"), at("对比辨析").alias("contrast"))
    about_cards = F.struct(F.coalesce(number("格式版本"), F.lit(1)).alias("schemaVersion"), at("生成器").alias("generator"), at("生成时间").alias("generatedAt"))
    c = gathered(c, F.coalesce(number("序号"), F.lit(1)), F.struct(card.alias("c"), about_cards.alias("m")), "x").select("path", "id", F.transform("x", lambda x: x["c"]).alias("memoryCards"), F.get("x", F.lit(0))["m"].alias("memoryCardMeta"))

    letter = lambda x: F.when(filled(at(f"选项{x}")), F.concat(F.lit(f"{x}. "), one_line(at(f"选项{x}"), CELL)))
    three = lambda h: F.array_compact(F.array(*(F.nullif(at(f"{h}{i}"), F.lit("")) for i in (1, 2, 3))))
    given = blank(F.nullif(at("扩展字段JSON"), F.lit("")))
    more = F.from_json(F.when(given == "", "{}").otherwise(given), "map<string,string>")
    named = dict(zip("questionSource type subject system difficulty caseInfo question answer briefExplanation mnemonic year explanation sourceType".split(), "题库来源 题型 学科 章节 难度 病例背景 题干 答案 一句话简析 记忆口诀 年份 解析纯文本 来源类型".split(), strict=True))
    grades = F.to_json(F.struct(at("证据等级").alias("evidenceGrade"), at("推理类型").alias("reasoningType")))
    q = found.where(F.col("sheet") == QUESTIONS).join(mine.select("path", F.col("bank").alias("_bank")), "path")
    q = q.select(
        "path", ident("ID"), F.coalesce(F.nullif(at("题库"), F.lit("")), F.col("_bank")).alias("bank"), *(at(h).alias(n) for n, h in named.items()), F.array_compact(F.array(*map(letter, "ABCDE"))).alias("options"),
        three("知识点").alias("knowledgePoints"), three("题目标签").alias("tags"), three("候选标签").alias("suggestedTags"), F.from_json(at("考点JSON"), FIELDS["studyPoints"]).alias("studyPoints"),
        F.coalesce(more, F.create_map(F.lit("importWarning"), F.lit(UNREADABLE))).alias("extensions"), F.from_json(grades, META).alias("explanationMeta"),
    )
    for part in (b, e, c):
        q = q.join(part, ["path", "id"], "left")
    return normal(q, ("path",))


def catalogue(found: DataFrame, schema: str) -> DataFrame:
    """`path` and the entries of the catalogues of opened() workbooks that are of the format."""
    at = lambda h: F.col("fields")[h]
    rows = found.where(F.col("sheet") == TAGS).join(near(about(found, schema).select("path")), "path", "left_semi")
    flat_rows = rows.select("path", at("学科").alias("subject"), at("标签").alias("label"), F.filter(F.split(blank(at("别名")), "[、,，;；|]"), lambda x: x != "").alias("aliases"), at("状态").alias("status"), at("使用次数").try_cast("double").cast("int").alias("usage"), at("合并至").alias("merged_into"))
    return catalog_entries(flat_rows, ("path",))

"""Whole rows in form, workbooks of six sheets both ways, edits of cells and blocks: pinned cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import editing, workbook
from lodestone.sources import office

SCHEMA = "example.question-set"
BLOCK = workbook.BLOCK
RAW = (
    "id string, bank string, question string, options array<string>, type string, answer string, explanation string, tags array<string>, knowledgePoints array<string>, questionSource string, "
    f"explanationBlocks array<{BLOCK}>, evidence array<{workbook.EVIDENCE}>, memoryCards array<{workbook.CARD}>, studyPoints array<struct<title:string,body:string>>, extensions map<string,string>, odd int"
)
TABLE = ("", "pitfalls", "table", "t", None, None, None, ["a", "b", "c"], [["1", "x|y"], ["", ""], ["2", "p\nq", "r"]])
LIST = ("", "pitfalls", "list", "易错点提示", "one\n\ntwo", None, None, None, None)
CALL = ("", "clinicalNotes", "callout", "", "mind", "warning", None, None, None)
SOURCE = ("", "2", "f.pdf", 12, 0, " q\r\nr ", "e", None, ["h", " ", None, "i"], None, 0.5, None)
CARDS = [("Card", "c1", "cue", None), ("card ", "c2", None, None), ("Tag", "c3", None, None), ("x", "ONE", None, None), ("y", "body", None, None), ("z", " ", None, None)]
ROWS = [
    ("1", "school", "what?", ["A. x", "B. y|z"], "A1", "B", "old", ["tag", "Tag", "b2、c3"], ["p1"], "Ｓet", [TABLE, LIST, CALL], [SOURCE, None], CARDS, [("s", "point")], {"k": "v", "odd": "0"}, 7),
    ("2", "school", "fill", None, "fill", '[["a"],["b"," c "]]', "### 答案\ntext\n\n### 易错\n- i1\n- i2\n### Z", None, None, None, None, None, None, None, None, None),
    ("3", None, None, None, None, None, "no heading", None, None, None, [], [], [], [], {}, None),
    (None, "school", "", [], "", "", "", [], [], "", [None, ("", "odd", "odd", None, "x", None, None, None, None)], None, None, None, None, None),
]


def normal(spark, rows=ROWS):
    return workbook.normal(spark.createDataFrame(rows, RAW))


def by_id(df):
    return {r.id: r.asDict(True) for r in df.collect()}


def test_rows_in_form(spark):
    found = by_id(normal(spark))
    one, two, three, last = found["1"], found["2"], found["3"], found[None]
    assert one["extensions"] == {"k": "v", "odd": "7"} and one["questionSource"] == "Set" and one["tags"] == ["tag", "b2", "c3"]
    assert [b["type"] for b in one["explanationBlocks"]] == ["table", "list", "callout"] and one["explanationBlocks"][0]["rows"] == [["1", "x|y", ""], ["2", "p\nq", "r"]]
    assert one["explanation"] == "### 易错点提示\n\n**t**\n\n| a | b | c |\n| --- | --- | --- |\n| 1 | x\\|y |  |\n| 2 | p<br>q | r |\n\n- one\n- two\n\n### 临床与操作要点\n\n> 注意：mind\n\n### 教材出处\n\n- 《f.pdf》（2） · 课本第12页"
    assert one["evidence"][0] | {"highlights": None} == dict(textbook="f.pdf", version="2", fileName="f.pdf", sourcePage=12, pdfPage=None, quote="q\nr", excerpt="e", contextSummary="", highlights=None, supportedClues=[], score=0.5, extractionMethod="text")
    assert one["evidence"][0]["highlights"] == ["h", "i"] and len(one["evidence"]) == 1
    assert [(c["title"], c["content"]) for c in one["memoryCards"]] == [("Card", "c1"), ("y", "body")] and one["memoryCardMeta"]["generator"] == "analysis-tool"
    assert json.loads(two["answer"]) == [["a"], ["b", "c"]]
    assert [(b["section"], b["type"], b["title"], b["text"], b["items"]) for b in two["explanationBlocks"]] == [("answerBasis", "paragraph", "答案", "text", []), ("pitfalls", "list", "易错", "", ["i1", "i2"])]
    assert three["explanation"] == "### 考点解析\n\nno heading" and three["memoryCards"] == [] and three["memoryCardMeta"] is None
    assert last["explanationBlocks"][0]["section"] == "analysis" and last["explanationBlocks"][0]["type"] == "paragraph"
    assert normal(spark, []).count() == 0


def test_form_is_stable(spark):
    once = normal(spark)
    assert by_id(workbook.normal(once)) == by_id(once)


def test_workbook_is_read_back(spark, tmp_path):
    rows = normal(spark).where("id IS NOT NULL").cache()
    tags = spark.createDataFrame([("s", "l", ["a", "b"], "odd", 4, None), ("", "x", None, None, None, None)], "subject string, label string, aliases array<string>, status string, usage int, merged_into string")
    sheets = workbook.flat(rows, SCHEMA, name="n", source="test", exported_at="now", tags=tags)
    assert list(sheets) == ["_meta", "题目", "解析区块", "教材证据", "背诵知识卡", "标签目录"]
    (tmp_path / "a.xlsx").write_bytes(office.workbook_bytes(sheets))
    (tmp_path / "b.xlsx").write_bytes(office.workbook_bytes(workbook.flat(rows.where("id = '1'"), "other")))
    (tmp_path / "c.xlsx").write_bytes(b"none")
    found = workbook.opened(office.workbooks(spark, str(tmp_path)))
    assert [r.name for r in workbook.about(found, SCHEMA).collect()] == ["n"]
    want = by_id(rows)
    want["3"] |= {"bank": "school"}
    got = by_id(workbook.nested(found, SCHEMA).drop("path"))
    for r in (*want.values(), *got.values()):
        for f in ("subject", "system", "difficulty", "caseInfo", "year", "sourceType", "question", "type", "answer"):
            r[f] = r[f] or ""
    for i, r in want.items():
        assert {f: v for f, v in got[i].items() if v != r[f]} == {}
    assert [r.asDict() for r in workbook.catalogue(found, SCHEMA).drop("path").collect()] == [dict(subject="s", label="l", aliases=["a", "b"], status="active", usageCount=4, mergedInto="")]


def test_sheets_that_people_changed(spark):
    head = {name: spark.createDataFrame([tuple([""] * len(cols.split()))], ", ".join(f"`{c}` string" for c in cols.split())).limit(0) for name, cols in workbook.HEADS.items()}
    put = lambda name, *rows: spark.createDataFrame([tuple(r.get(c, "") for c in workbook.HEADS[name].split()) for r in rows], ", ".join(f"`{c}` string" for c in workbook.HEADS[name].split()))
    sheets = head | {
        "_meta": put("_meta", {"key": "schema", "value": SCHEMA}, {"key": "schemaVersion", "value": "2.0"}, {"key": "bank", "value": "kaoyan"}),
        "题目": put("题目", {"ID": " 1 ", "题干": "q", "选项B": "only", "扩展字段JSON": "{bad", "考点JSON": "no"}, {"ID": "", "题干": "no id"}),
        "解析区块": put("解析区块", *({"题目ID": "1", "区块序号": b, "类型": "list", "行序号": n, "正文": t} for b, n, t in (("2", "10", "ten"), ("2", "9", "nine"), ("1", "x", "first")))),
        "教材证据": put("教材证据", {"题目ID": "1", "课本页码": "twelve", "PDF页码": "3", "相似度": "?", "教材原文": "quote"}),
        "背诵知识卡": put("背诵知识卡", {"题目ID": "", "标题": "lost", "独立背诵正文": "lost"}),
    }
    rows = workbook.opened(workbook.as_rows(sheets, "p"))
    found = by_id(workbook.nested(rows, SCHEMA))
    assert set(found) == {"1", ""} and found["1"]["bank"] == "kaoyan" and found["1"]["options"] == ["B. only"]
    assert found["1"]["extensions"] == {"importWarning": workbook.UNREADABLE} and found["1"]["studyPoints"] == []
    assert [b["items"] for b in found["1"]["explanationBlocks"]] == [["first"], ["nine", "ten"]]
    assert [(e["sourcePage"], e["pdfPage"], e["score"]) for e in found["1"]["evidence"]] == [(None, 3, 0.0)] and found[""]["memoryCards"] == []
    assert workbook.nested(workbook.opened(workbook.as_rows(sheets | {"_meta": head["_meta"]})), SCHEMA).count() == 0


def test_exchange_edits_keep_the_workflow(spark):
    rows = normal(spark).withColumn("review_status", F.lit("approved"))
    edits = spark.createDataFrame([("1", [CALL], " new ", ["t1"]), ("3", None, "m", None), ("9", None, "x", None), (None, None, "x", None)], f"id string, explanationBlocks array<{BLOCK}>, mnemonic string, tags array<string>")
    found = by_id(workbook.exchange_edited(rows, edits, keep=("review_status",)))
    assert len(found) == 4 and {i for i, r in found.items() if r["edited"]} == {"1", "3"} and {r["review_status"] for r in found.values()} == {"approved"}
    assert found["1"]["mnemonic"] == "new" and found["1"]["tags"] == ["t1"] and found["1"]["explanation"].startswith("### 临床与操作要点\n\n> 注意：mind")
    assert found["3"]["mnemonic"] == "m" and found["3"]["explanation"] == "### 考点解析\n\nno heading"


def test_cells(spark):
    rows = spark.createDataFrame([("1", "fill", ["x"], "a", ["t"]), ("1", "A1", None, None, None), ("2", None, None, "b", None), (None, "A1", None, "n", None)], "id string, type string, options array<string>, answer string, tags array<string>")
    edits = [("1", "answer", '[["p"]]', 1), ("1", "options", "old", 1), ("1", "options", " a | b\n\nc", 2), ("2", "type", " fill ", 1), ("2", "answer", "bad json", 1), ("2", "type", "odd", 9), ("2", "tags", "a、b;c|d", 1), ("9", "answer", "x", 1), (None, "answer", "x", 1), ("1", "nope", "x", 1), ("1", "tags", None, 3)]
    done, refused = editing.cells_set(rows, spark.createDataFrame(edits, "id string, field string, value string, at int"), ["type", "options", "answer", "tags"])
    got = sorted((tuple(r) for r in done.collect()), key=repr)
    assert got == sorted([("1", "fill", ["a", "b", "c"], '[["p"]]', ["t"]), ("1", "A1", ["a", "b", "c"], '[["p"]]', None), ("2", "fill", None, "bad json", ["a", "b", "c"]), (None, "A1", None, "n", None)], key=repr)
    assert sorted(r.reason for r in refused.collect()) == ["no such field", "no such row", "no such row", "no value", "value not allowed"]
    assert editing.cells_set(rows.limit(0), spark.createDataFrame(edits, "id string, field string, value string, at int"), ["answer"])[0].count() == 0


def test_bulk_values(spark):
    rows = spark.createDataFrame([("1", "A1", None), ("2", None, ["x"]), (None, "A2", None)], "id string, type string, tags array<string>")
    assert sorted(r.type or "" for r in editing.bulk_set(rows, "type", " judge ", F.col("id") > "1").collect()) == ["A1", "A2", "judge"]
    assert {tuple(r.tags) for r in editing.bulk_set(rows, "tags", "a、b", F.lit(True)).collect()} == {("a", "b")}
    for field, value in (("type", "odd"), ("bank", "x"), ("difficulty", "X"), ("tags", "  ")):
        with pytest.raises(ValueError, match="cannot be"):
            editing.bulk_set(rows, field, value, F.lit(True))


def test_issues_go_to_the_resolved(spark):
    rows = spark.createDataFrame([(1, {"importIssues": '["a"]', "k": "v"}), (2, {"importIssues": "[]"}), (3, None), (4, {"k": "v"}), (5, {"importIssues": '["b"]'}), (None, {"importIssues": '["c"]'})], "id int, extensions map<string,string>")
    got = {r.id: r.extensions for r in editing.issues_resolved(rows, F.col("id") < 5, F.lit("now")).collect()}
    assert got == {1: {"k": "v", "resolvedImportIssues": '["a"]', "importIssues": "[]", "sourceCheckedAt": "now"}, 2: {"importIssues": "[]"}, 3: None, 4: {"k": "v"}, 5: {"importIssues": '["b"]'}, None: {"importIssues": '["c"]'}}


def test_blocks_change_type(spark):
    rows = spark.createDataFrame([("text", ("i", "s", "paragraph", "t", "a|b\n\n c \nd\te|f", None, None, None, None)), ("list", ("i", "s", "list", "t", None, None, ["x", "y"], None, None)), ("table", ("i", "s", "table", "t", None, None, None, ["p", "q"], [["1", "2"], ["3", None]])), ("call", ("i", "s", "callout", "t", "", "info", None, None, None)), ("none", None)], f"k string, b {BLOCK}")
    kinds = ("paragraph", "callout", "list", "table")
    got = {r.k: r for r in rows.select("k", *(editing.converted(F.col("b"), k).alias(k) for k in kinds)).collect()}
    assert got["text"].list.items == ["a|b", "c", "d\te|f"] and got["text"].table.rows == [["a", "b"], ["c", ""], ["d", "e", "f"]] and got["text"].table.columns == ["项目", "说明"] and got["text"].table.text is None
    assert got["text"].callout.tone == "important" and got["text"].callout.text == got["text"].paragraph.text and got["text"].table.blockId == "i"
    assert got["list"].paragraph.text == "x\ny" and got["list"].table.rows == [["", ""]] and got["table"].callout.text == "1、2\n3、" and got["table"].list.items == [""]
    assert got["call"].list.items == [""] and got["call"].callout.tone == "info" and got["call"].table.rows == [["", ""]] and got["none"].list is None
    both = spark.createDataFrame([(["list", None], [("i", "s", "paragraph", "t", "a", None, None, None, None)] * 3)], f"kinds array<string>, b array<{BLOCK}>")
    assert [b.type for b in both.select(editing.blocks_converted(F.col("b"), F.col("kinds")).alias("b")).first().b] == ["list", "paragraph", "paragraph"]
    with pytest.raises(ValueError, match="no type"):
        editing.converted(F.col("b"), "odd")


def test_block_limits_and_places(spark):
    one = lambda n, **f: ("", "s", "table", "", None, None, f.get("items"), f.get("columns"), f.get("rows"))
    rows = spark.createDataFrame([(1, [one(0)] * 13), (2, [one(0, columns=["c"] * 6, rows=[["x"]] * 21, items=["i"] * 21)]), (3, [one(0, columns=["c"] * 5, rows=[["x"]] * 20, items=["i"] * 20)] * 12), (4, [])], f"k int, b array<{BLOCK}>")
    assert {r.k: r.x for r in rows.select("k", editing.block_limits(F.col("b")).alias("x")).collect()} == {1: ["blocks"], 2: ["columns", "rows", "items"], 3: [], 4: []}
    letters = spark.createDataFrame([(list("abcd"),)], "b array<string>")
    move = lambda at, by: "".join(letters.select(editing.moved(F.col("b"), at, by).alias("b")).first().b)
    assert [move(0, 1), move(3, -3), move(1, 2), move(0, -1), move(3, 1), move(2, 0), move(9, -8)] == ["bacd", "dabc", "acdb", "abcd", "abcd", "abcd", "abcd"]


def test_selections(spark):
    saved = spark.createDataFrame([("u", 1), ("u", 1), ("v", 2), ("v", None)], "user string, library_id int")
    usable = spark.createDataFrame([(1,), (1,), (None,), (3,)], "library_id int")
    assert sorted(tuple(r) for r in editing.still_usable(saved, usable).collect()) == [("u", 1), ("u", 1)]
    assert sorted(r.library_id for r in editing.selected_too(saved, usable, "library_id").collect()) == [1, 2, 3]

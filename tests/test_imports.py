"""Specialty sheets, folders of mixed files, page references in prose, chunks within pages: pinned cases."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, pages
from lodestone.sources import dispatch, office, specialty

HEAD = ["学科", "章节", "题干", "A", "B", "C", "D", "E", "答案", "解析", "F"]
BODY = [
    ["药理学", "总论", "患者 发热 3 天", "甲", "乙", "丙", "", "nan", "b", "说明", ""],
    ["药理学", "总论", "哪些正确", "甲", "乙", "丙", "丁", "戊", "C、A,A", "", ""],
    ["药理学", "总论", "没有答案", "甲", "乙", "", "", "", "", "", "己"],
    ["药理学", "总论", "哪些正确", "甲", "乙", "丙", "丁", "戊", "AC", "x", ""],
    ["", "", "", "", "", "", "", "", "", "", ""],
]
KIND = "path string, sheet string, row int, cells array<string>"


def sheet(wrong=lambda x: x, name="p"):
    return [(name, "s", i, [wrong(c) for c in row]) for i, row in enumerate([HEAD, *BODY], 1)]


def flat(spark, rows):
    return specialty.flat_questions(spark.createDataFrame(rows, KIND))


def test_flat_sheet_of_eleven_columns(spark):
    found = {r.row: r for r in flat(spark, sheet()).collect()}
    assert sorted(found) == [2, 3, 4, 5] and {r.codec for r in found.values()} == {""}
    assert (found[2].type, found[2].answer, found[2].options, found[2].explanation) == ("A2", "B", ["A. 甲", "B. 乙", "C. 丙"], "说明")
    assert (found[3].type, found[3].answer, found[3].issues) == ("multiple", "AC", [])
    assert (found[4].type, found[4].answer, found[4].issues) == ("A1", "", ["no answer", "options F are not supported"])
    assert found[3].digest == found[5].digest and [found[3].occurrence, found[5].occurrence, found[3].n_same] == [1, 2, 2] and found[5].id == f"xlsx_{found[5].digest}_2"
    assert tuple(specialty.flat_stats(flat(spark, sheet())).first()) == ("p", "", "药理学", 4, 3, 2, 1, 2)


@pytest.mark.parametrize(("codec", "written", "meant"), [("latin1-gbk", "gbk", "latin-1"), ("latin1-utf8", "utf-8", "latin-1"), ("gbk-utf8", "utf-8", "gbk")])
def test_wrongly_decoded_sheets_are_repaired(spark, codec, written, meant):
    def wrong(x):
        try:
            return x.encode(written).decode(meant)
        except UnicodeDecodeError:
            return x

    names = [wrong(h) for h in HEAD]
    if sum(specialty.repaired(a, codec) == b for a, b in zip(names, HEAD)) < len(HEAD):
        pytest.skip("this header has bytes that the codec cannot hold")
    plain, found = ({(r.row, r.subject, r.question, *r.options, r.answer, r.type, r.digest) for r in flat(spark, sheet(w)).collect()} for w in (lambda x: x, wrong))
    assert plain == found
    assert {r.codec for r in flat(spark, sheet(wrong)).collect()} == {codec}


def test_other_sheets_have_no_rows(spark):
    assert flat(spark, [("p", "s", 1, ["学科", "章节", "题干"]), ("p", "s", 2, ["a", "b", "c"])]).count() == 0
    assert flat(spark, sheet()[:1]).count() == 0 and flat(spark, []).count() == 0
    assert specialty.header_codec([None, "A", *HEAD]) == ("", ["", "A", *HEAD])


def test_a_folder_of_every_shape_is_one_job(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "A")], "question string, answer string")
    (tmp_path / "book.bin").write_bytes(office.workbook_bytes({"one": rows}))
    (tmp_path / "array.txt").write_text('[{"question": "q2"}, {"question": "q3", "options": ["a", "b"]}]')
    (tmp_path / "held.json").write_text('﻿{"data": [{"question": "q4"}]}', encoding="utf-8")
    (tmp_path / "chapters.json").write_text('[{"chapter": "c1", "questions": [{"stem": "q5"}]}]')
    (tmp_path / "lines.json").write_text('{"question": "q6"}\n\n{"question": \n{"question": "q7"}\n')
    (tmp_path / "old.txt").write_bytes("题目".encode("gb18030"))
    (tmp_path / "broken.json").write_text('[{"question": "q8"')
    (tmp_path / "scalar.json").write_text('["q"]')
    (tmp_path / "paper").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "base").write_bytes(b"SQLite format 3\x00...")
    (tmp_path / "empty").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "words", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one line</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "other", "w") as z:
        z.writestr("x", "y")
    records = dispatch.folder_records(spark, str(tmp_path))
    found = dispatch.as_questions(records, {"question": ["question", "stem", "text"], "options": ["options"]})
    told = sorted((r.path.rpartition("/")[2], r.shape, r.question or "", bool(r.error)) for r in found.collect())
    assert told == sorted([
        ("array.txt", "json", "q2", False), ("array.txt", "json", "q3", False), ("base", "database", "", True), ("book.bin", "workbook", "q1", False), ("broken.json", "json", "", True), ("chapters.json", "json", "q5", False), ("held.json", "json", "q4", False),
        ("lines.json", "lines", "", True), ("lines.json", "lines", "q6", False), ("lines.json", "lines", "q7", False), ("old.txt", "text", "题目", False), ("other", "archive", "", True), ("paper", "pdf", "", True), ("scalar.json", "json", "", True), ("words", "document", "one line", False),
    ])
    assert [json.loads(r.options) for r in found.where("question = 'q3'").collect()] == [["a", "b"]]
    assert records.where("part = 'c1'").count() == 1


def test_large_files_of_lines_are_read_in_splits(spark, tmp_path, monkeypatch):
    """The same records and numbers as of whole files, of many tasks; other large files stay whole."""
    line = lambda i: "" if i % 50 == 7 else '{"question": ' if i % 50 == 9 else json.dumps({"question": f"题{i} \u2028", "n": i}, ensure_ascii=False)
    (tmp_path / "a b%20[1].json").write_text("\ufeff\n" + "\r\n".join(map(line, range(2000))), encoding="utf-8")
    (tmp_path / "array.json").write_text(json.dumps([{"question": f"q{i}"} for i in range(3000)]))
    (tmp_path / "one.json").write_text("\n" + json.dumps({"data": [{"question": f"q{i}"} for i in range(3000)]}) + "\n\n")
    (tmp_path / "old.json").write_bytes("\n".join(map(line, range(3000))).encode("gb18030", "replace"))
    (tmp_path / "small.json").write_text('{"question": "x"}\n{"question": "y"}\n')
    told = lambda: sorted(tuple(r) for r in dispatch.folder_records(spark, str(tmp_path)).collect())
    whole = told()
    monkeypatch.setattr(dispatch, "WHOLE", 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert len(dispatch.large_lines(spark, str(tmp_path), "gb18030")[1]) == 1
        assert told() == whole and len(whole) > 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_go_to_the_rows(spark):
    """A join by sheet would bring all rows of a sheet to one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame(sheet(), KIND)
        for found, n in ((specialty.flat_questions(rows), 4), (office.headed(rows.withColumn("error", F.lit("")), ["题干"]), 5)):
            assert found.count() == n and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_references_are_rewritten_once(spark):
    rows = spark.createDataFrame([("见第3页、第5页，第3页。第33页", {3: 5, 5: 3}), ("第3页", None), (None, {3: 5}), ("", {3: 5}), ("第三页 第3 页", {3: 5}), ("第7页第8页", {7: 8, 8: None})], "t string, m map<int,int>")
    found = [r[0] for r in rows.select(pages.rewritten_references(F.col("t"), F.col("m"))).collect()]
    assert found == ["见第5页、第3页，第5页。第33页", "第3页", None, "", "第三页 第3 页", "第8页第8页"]


def test_an_offset_moves_evidence_and_prose(spark):
    kind = "id int, explanation string, evidence array<struct<source_path:string,pdf_page:int,source_page:int>>"
    rows = spark.createDataFrame([(1, "第10页与第11页、第12页", [("a", 20, 10), ("a", 21, 11), ("b", 30, 12)]), (2, "第10页", [("b", 20, 10)]), (3, "第10页", None), (4, "第2页", [("a", 5, 2), ("a", None, 40), ("a", None, None)])], kind)
    found = {r.id: r for r in pages.offset_applied(rows, F.lit(9), F.array(F.lit("a"))).collect()}
    assert found[1].explanation == "第11页与第12页、第12页" and [tuple(e) for e in found[1].evidence] == [("a", 20, 11), ("a", 21, 12), ("b", 30, 12)]
    assert [found[i].changed for i in (1, 2, 3, 4)] == [True, False, False, True] and found[2].explanation == found[3].explanation == "第10页"
    assert [tuple(e) for e in found[4].evidence] == [("a", 5, None), ("a", 40, 31), ("a", None, None)] and found[4].explanation == "第2页"


def test_chunks_stay_within_pages_and_headings(spark):
    text = "# One\nfirst\n\nsecond\n| a | b |\nthird\n# Two\nfourth\n" + "x" * 1000
    found = chunking.page_chunks(spark.createDataFrame([(1, 1, text), (1, 2, "more"), (2, 1, None), (3, 1, " \n")], "doc_id long, page int, text string")).orderBy("doc_id", "page", "chunk_index").collect()
    assert [(r.page, r.chunk_index, r.kind, r.title) for r in found] == [(1, 0, "paragraph", "One"), (1, 1, "table", "One"), (1, 2, "paragraph", "One"), (1, 3, "paragraph", "Two"), (1, 4, "paragraph", "Two"), (1, 5, "paragraph", "Two"), (2, 0, "paragraph", None)]
    assert found[0].chunk_text == "first\n\nsecond" and found[3].chunk_text == "fourth\n" + "x" * 493 and len(found[5].chunk_text) == 107

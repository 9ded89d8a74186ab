"""Workbooks and word-processor files: written, read back, mapped, and damaged ones."""

import zipfile

from pyspark.sql import functions as F

from lodestone.operators import audits
from lodestone.sources import office, readers, writers

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_workbooks_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", "what <is> & this?", "x" * 10), ("2", None, "  y"), ("3", "a\nb", "")], "ID string, Question string, `Option A` string").coalesce(1)
    (tmp_path / "a.xlsx").write_bytes(office.workbook_bytes({"Sheet & 1": rows, "empty": rows.limit(0)}))
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    found = office.workbooks(spark, str(tmp_path))
    errors = found.where("error <> ''").collect()
    assert len(errors) == 1 and errors[0].path.endswith("broken.xlsx")
    got = [(r.sheet, r.row, r.cells) for r in found.where("error = ''").orderBy("sheet", "row").collect()]
    assert got[0] == ("Sheet & 1", 1, ["ID", "Question", "Option A"]) and got[1][2] == ["1", "what <is> & this?", "x" * 10] and got[2][2] == ["2", "", "  y"]
    headed = office.headed(found, ["question"])
    assert [(r.row, r.fields["Question"]) for r in headed.orderBy("row").collect()] == [(2, "what <is> & this?"), (3, ""), (4, "a\nb")]
    header = ["ID", "Question", "Option A"]
    mapping = readers.column_mapping(header, {"id": "id", "QUESTION": "question", "optiona": "a"})
    flat = headed.select(*(F.col("fields")[h].alias(h) for h in header))
    assert sorted((r.id, r.options) for r in readers.mapped(flat, mapping, ["a"]).collect()) == [("1", ["A. " + "x" * 10]), ("2", ["A. y"]), ("3", [])]


def test_cells_of_other_programs(spark, tmp_path):
    main = office.MAIN[1:-1]
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office.LINK[1:-3]}"><sheets><sheet name="s" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="x" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2"><v>3.0</v></c><c r="AA2" t="b"><v>1</v></c></row><row r="3"><c r="A3"/></row><row r="4"><c r="A4"><v>2.5</v></c></row></sheetData></worksheet>')
    got = [(r.row, r.cells) for r in office.workbooks(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [(2, ["", "bc", "", "3", *[""] * 22, "true"]), (4, ["2.5"])]


def test_headings_make_questions(spark, tmp_path):
    p = lambda style, text: f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Heading1", "chapter") + p("Heading2", "q1") + p("", "lost") + p("h3", "answer") + p("", "one") + p("", " ") + p("", "two") + p("Heading2", "q2") + p("h3", "answer") + p("", "three")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="h3"><w:name w:val="heading 3"/></w:style></w:styles>')
    with zipfile.ZipFile(tmp_path / "evil.docx", "w") as z:
        z.writestr("word/document.xml", f'<!DOCTYPE x [<!ENTITY a "b">]><w:document xmlns:w="{W}"/>')
    found = office.documents(spark, str(tmp_path))
    assert found.where("error <> ''").count() == 1
    got = {(r.chapter, r.question): r.fields for r in audits.from_headings(found.where("error = ''")).collect()}
    assert got == {("chapter", "q1"): {"answer": "one\ntwo"}, ("chapter", "q2"): {"answer": "three"}}


def test_questions_go_to_sheets(spark):
    rows = spark.createDataFrame([(1, "q\x01", [("s", "t")])], "id long, question string, blocks array<struct<section:string,text:string>>")
    data = office.workbook_bytes(writers.sheets(rows))
    got = [(s, c) for s, _, c in office.workbook_rows(data)]
    assert got == [("questions", ["id", "question"]), ("questions", ["1", "q"]), ("blocks", ["id", "at", "section", "text"]), ("blocks", ["1", "0", "s", "t"])]

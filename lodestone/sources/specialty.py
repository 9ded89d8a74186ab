"""Flat question sheets of one speciality: a known header, if need be read through the codec that it was wrongly decoded
with, and every row kept, with what is wrong with it.

A sheet's header is its first row. Of the ways of decoding it again, the one that gives most known names is taken, if it
gives eight or more, and if it is not the plain one, three more than that. Sheets without such a header have no rows here.
Cells are repaired word by word, with the same codec; a word that does not fit stays. `nan` and null cells are blank; rows
without a cell go. Repeated rows are kept and numbered; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..store import near, shipped

# fixed values: names of the sheet's columns, what tells of a case, ways of wrong decoding (written with, meant for)
SUBJECT, SYSTEM, QUESTION, ANSWER, EXPLANATION = "学科", "章节", "题干", "答案", "解析"
OPTIONS = "ABCDE"
KNOWN = (SUBJECT, SYSTEM, QUESTION, ANSWER, EXPLANATION, *OPTIONS)
PERSON, COURSE = "患者|病人|男性|女性|岁|主诉|入院", "天|月|年|疼痛|发热|咳|呕|查体|检查|血|尿|给予|服用"
CODECS = {"latin1-gbk": ("latin-1", "gbk"), "latin1-utf8": ("latin-1", "utf-8"), "gbk-utf8": ("gbk", "utf-8")}
LEAST, GAIN = 8, 3


def repaired(text: str, codec: str) -> str:
    """Each word encoded as it was wrongly decoded, and decoded as it was meant, where that is possible."""
    if not codec:
        return text
    written, meant = CODECS[codec]

    def word(m: re.Match) -> str:
        try:
            return m[0].encode(written).decode(meant)
        except UnicodeError:
            return m[0]

    return re.sub(r"\S+", word, text)


def header_codec(header: list[str | None]) -> tuple[str, list[str]] | None:
    """The codec ('' for none) under which a header has most known names, and the header so read; None if too few."""
    plain = [(h or "").strip() for h in header]
    read = {codec: [repaired(h, codec) for h in plain] for codec in ("", *CODECS)}
    known = {codec: len({*KNOWN} & {*names}) for codec, names in read.items()}
    best = max(read, key=lambda codec: known[codec])  # of equals the first
    if known[best] < LEAST or best and known[best] < known[""] + GAIN:
        return None
    return best, read[best]


def flat_questions(rows: DataFrame) -> DataFrame:
    """Questions of workbook rows (path, sheet, row, cells), see office.workbooks(): path, sheet, row, codec, subject,
    system, question, options, answer (letters, sorted, once each), type, explanation, digest, occurrence, id, issues,
    n_same (rows of the file with the same content)."""
    shipped(rows.sparkSession)

    def heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(p, s, r, header_codec(list(c))) for p, s, r, c in zip(part["path"], part["sheet"], part["row"], part["cells"], strict=True)]
            yield pd.DataFrame([(p, s, r, x[0], x[1]) for p, s, r, x in found if x], columns=["path", "sheet", "top", "codec", "head"])

    @F.pandas_udf("array<string>")
    def read(cells: pd.Series, codec: pd.Series) -> pd.Series:
        def one(x: str | None, c: str) -> str:
            text = (x or "").strip()
            return "" if text.casefold() == "nan" else unicodedata.normalize("NFC", repaired(text, c))

        return pd.Series([[one(x, c) for x in row] for row, c in zip(cells, codec, strict=True)])

    firsts = rows.groupBy("path", "sheet").agg(F.min(F.struct("row", "cells")).alias("h")).select("path", "sheet", F.col("h.row").alias("row"), F.col("h.cells").alias("cells"))
    tops = near(firsts.mapInPandas(heads, "path string, sheet string, top int, codec string, head array<string>"))
    body = rows.select("path", "sheet", "row", "cells").join(tops, ["path", "sheet"]).where("row > top").withColumn("cells", read("cells", "codec"))
    body = body.where(F.exists("cells", lambda c: c != ""))
    cell = lambda name: F.coalesce(F.get("cells", F.array_position("head", name).cast("int") - 1), F.lit(""))
    listed = F.filter(F.array(*(F.when(cell(x) != "", F.concat(F.lit(f"{x}. "), cell(x))) for x in OPTIONS)), lambda o: o.isNotNull())
    beyond = F.array_compact(F.array(*(F.when(cell(chr(i)) != "", F.lit(chr(i))) for i in range(ord("F"), ord("Z") + 1))))
    letters = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(cell(ANSWER)), F.lit("[A-E]"), F.lit(0)))), "")
    case = cell(QUESTION).rlike(PERSON) & cell(QUESTION).rlike(COURSE)
    made = body.select("path", "sheet", "row", "codec", cell(SUBJECT).alias("subject"), cell(SYSTEM).alias("system"), cell(QUESTION).alias("question"), listed.alias("options"), letters.alias("answer"), cell(EXPLANATION).alias("explanation"), beyond.alias("_beyond"), case.alias("_case"))
    kind = F.when(F.length("answer") > 1, "multiple").when((F.length("answer") == 1) & F.col("_case"), "A2").otherwise("A1")
    text = lambda c: F.to_json(F.col(c).cast("variant"))
    content = F.concat(F.lit("["), F.concat_ws(",", text("subject"), text("system"), text("question"), F.to_json("options"), text("answer")), F.lit("]"))
    issues = F.array_compact(F.array(F.when(F.col("answer") == "", F.lit("no answer")), F.when(F.size("_beyond") > 0, F.concat(F.lit("options "), F.array_join("_beyond", ","), F.lit(" are not supported")))))
    made = made.withColumns({"type": kind, "digest": F.substring(F.sha1(content), 1, 16), "issues": issues})
    own = Window.partitionBy("path", "digest")
    made = made.withColumns({"occurrence": F.row_number().over(own.orderBy("sheet", "row")), "n_same": F.count("*").over(own)})
    return made.withColumn("id", F.concat(F.lit("xlsx_"), "digest", F.lit("_"), F.col("occurrence").cast("string"))).drop("_beyond", "_case")


def flat_stats(questions: DataFrame) -> DataFrame:
    """By path: rows, those that can be imported, without explanation, groups of equal rows and rows in them."""
    repeated = F.col("n_same") > 1
    return questions.groupBy("path").agg(
        F.max("codec").alias("codec"), F.min_by(F.when(strip(F.col("subject")) != "", F.col("subject")), F.when(strip(F.col("subject")) != "", F.struct("sheet", "row"))).alias("subject"), F.count("*").alias("rows"), F.count_if((F.size("issues") == 0) & (F.col("answer") != "")).alias("importable"),
        F.count_if(F.col("explanation") == "").alias("unexplained"), F.count_if(repeated & (F.col("occurrence") == 1)).alias("groups"), F.count_if(repeated).alias("repeated"),
    )

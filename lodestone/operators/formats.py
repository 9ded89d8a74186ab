"""Fields of questions brought into form: blocks, answers, options, labels, short texts; warnings of rows; old index profiles.

Column functions, but for the last two. Null fields count as blank, null lists as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line, plain, squeezed
from .questions import block_id

SECTIONS = ("analysis", "answerBasis", "pitfalls", "clinicalNotes")
KINDS = ("paragraph", "list", "table", "callout")
TONES = ("info", "important", "warning")
# fixed values: learner-facing labels of question types, and answers of true-or-false questions
LABELS = {"B": "B 型题 · 配伍题", "X": "X 型题 · 多项选择", "A3A4": "A3/A4 型题 · 病例组最佳选择", "A4": "A4 型题 · 病例组递进题", "A3": "A3 型题 · 病例组单选", "A2": "A2 型题 · 病例摘要单选", "A1": "A1 型题 · 单句最佳选择", "judge": "判断题"}
TRUE, FALSE = ("对", "正确", "√"), ("错", "错误", "×", "X")


def type_label(original: Column, normalized: Column) -> Column:
    """What a learner reads as a question's type, from the type as given and the normalised one."""
    raw = F.upper(F.regexp_replace(F.coalesce(original, F.lit("")), r"\s+", ""))
    kind, has = F.coalesce(normalized, F.lit("")), lambda t: F.contains(raw, F.lit(t))
    out = F.when(raw.startswith("B"), LABELS["B"]).when(raw.startswith("X") | (kind == "multiple"), LABELS["X"]).when(has("A3") & has("A4"), LABELS["A3A4"]).when(has("A4"), LABELS["A4"])
    for t in ("A3", "A2", "A1"):
        out = out.when(has(t) | (kind == t), LABELS[t])
    return out.when(kind == "judge", LABELS["judge"]).otherwise("")


def answer(value: Column) -> Column:
    """Answer letters once each in order; else the words of a true-or-false question; else the text without a last dot."""
    text = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""))
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-E]"), F.lit(0)))
    other = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[。.]+$", "")
    return F.when(F.size(letters) > 0, F.array_join(letters, "")).when(text.isin(*TRUE), TRUE[1]).when(text.isin(*FALSE), FALSE[1]).otherwise(other)


def options(lines: Column) -> Column:
    """Lines as options `A. text`: several in a line are parted, a letter is told from its place where a line has none."""
    mark = r"(?i)(?:^|(?<=\s))(?=[A-E]\s*[.．、：:]\s*)"
    whole = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), squeezed), lambda x: x != "")
    parted = F.transform(whole, lambda x: F.filter(F.split(x, mark), lambda p: p.rlike(r"(?i)^[A-E]\s*[.．、：:]")))
    found = F.zip_with(whole, parted, lambda x, p: F.when(F.size(p) > 1, p).otherwise(F.array(x)))

    def one(acc: Column, x: Column, several: Column) -> Column:
        body = F.trim(F.regexp_extract(x, r"(?i)^[A-E]\s*[.．、：:]?\s*(.*)$", 1))
        own = F.concat(F.upper(F.substring(x, 1, 1)), F.lit(". "), body)
        told = F.when(F.size(acc) < 5, F.concat(F.char(65 + F.size(acc)), F.lit(". "), x)).otherwise(x)
        return F.when(x.rlike(r"(?i)^[A-E]\s*[.．、：:]?\s*.+$") & (body != ""), F.concat(acc, F.array(own))).when(several, acc).otherwise(F.concat(acc, F.array(told)))

    flat = F.flatten(F.transform(found, lambda p: F.transform(p, lambda x: F.struct(x.alias("x"), (F.size(p) > 1).alias("several")))))
    return F.aggregate(flat, F.array().cast("array<string>"), lambda acc, s: one(acc, s["x"], s["several"]))


def brief(*values: Column) -> Column:
    """The first sentence of several texts, cut to 160 characters."""
    text = squeezed(F.concat_ws(" ", *(F.nullif(v, F.lit("")) for v in values)))
    return F.substring(F.trim(F.get(F.split(text, "(?<=[。！？!?])\\s*", 2), F.lit(0))), 1, 160)


def blocks(found: Column, most: int = 12) -> Column:
    """Blocks (section, type, title, text, items, columns, rows, tone) in form, the first `most` of those given: unknown
    sections and types become analysis paragraphs; texts, items, tables without content go; tables have 2 to 5 columns, 20
    rows at most, each filled up to the columns; each gets its id."""
    content = lambda c, n: F.substring(plain(F.coalesce(c, F.lit(""))), 1, n)
    cell = lambda c, n: one_line(content(c, n), n)
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def tidy(b: Column, i: Column) -> Column:
        kind = F.when(b["type"].isin(*KINDS), b["type"]).otherwise("paragraph")
        section = F.when(b["section"].isin(*SECTIONS), b["section"]).otherwise("analysis")
        given = F.coalesce(b["items"], F.split(F.coalesce(b["text"], F.lit("")), "\n"))
        items = F.when(kind == "list", F.slice(F.filter(F.transform(given, lambda x: cell(x, 500)), lambda x: x != ""), 1, 20)).otherwise(none)
        columns = F.when(kind == "table", F.slice(F.filter(F.transform(F.coalesce(b["columns"], none), lambda x: cell(x, 80)), lambda x: x != ""), 1, 5)).otherwise(none)
        filled = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(columns), F.lit(1)) - 1), lambda k: content(F.get(r, k), 500))
        rows = F.when(kind == "table", F.filter(F.transform(F.slice(F.filter(F.coalesce(b["rows"], nothing), lambda r: r.isNotNull()), 1, 20), filled), lambda r: F.exists(r, lambda x: x != ""))).otherwise(nothing)
        text = F.when(kind.isin("paragraph", "callout"), content(b["text"], 4000)).otherwise("")
        tone = F.when(kind == "callout", F.when(b["tone"].isin(*TONES), b["tone"]).otherwise("info")).otherwise("")
        title = F.coalesce(one_line(b["title"], 40), F.lit(""))
        fine = F.when(kind == "list", F.size(items) > 0).when(kind == "table", (F.size(columns) >= 2) & (F.size(rows) > 0)).otherwise(text != "")
        made = F.struct(block_id(i, section, kind, title, text, F.array_join(items, "\n"), F.array_join(columns, "\n")).alias("blockId"), section.alias("section"), kind.alias("type"), title.alias("title"), text.alias("text"), tone.alias("tone"), items.alias("items"), columns.alias("columns"), rows.alias("rows"))
        return F.when(fine, made)

    return F.array_compact(F.transform(F.slice(found, 1, most), tidy))


def warnings(rows: DataFrame, imported: DataFrame, order: str = "ordinal") -> DataFrame:
    """rows (id, order, errors) with `warnings`: the errors, ids of earlier rows, ids that are there already (imported: id)."""
    first = rows.where("trim(id) <> ''").groupBy(F.trim("id").alias("_id")).agg(F.min(order).alias("_first"))
    known = imported.select(F.trim(F.col("id").cast("string")).alias("_id")).distinct().withColumn("_known", F.lit(True))
    found = rows.withColumn("_id", F.trim("id")).join(first, "_id", "left").join(known, "_id", "left")
    again = F.when(F.col("_first") < F.col(order), F.concat(F.lit("id as in row "), F.col("_first").cast("string")))
    there = F.when(F.col("_known"), F.lit("id is imported"))
    return found.withColumn("warnings", F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.array_compact(F.array(again, there)))).drop("_id", "_first", "_known")


def adoptable(files: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """Files (file_id, status, fingerprint) without a profile whose every chunk (file_id, dim) has the dimension."""
    dims = chunks.groupBy("file_id").agg(F.min("dim").alias("lo"), F.max("dim").alias("hi"), F.count_if(F.col("dim").isNull()).alias("none"))
    rows = files.where((F.coalesce("fingerprint", F.lit("")) == "") & F.col("status").isin("ready", "warning"))
    return rows.join(dims.where((F.col("lo") == dimension) & (F.col("hi") == dimension)), "file_id", "left_semi")

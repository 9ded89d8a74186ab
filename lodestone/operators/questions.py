"""Question import: flattening, splitting raw text, repair, rules, normalised blocks, prompts and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import limited_list, one_line, question_type, strip

LETTERS = [chr(65 + i) for i in range(26)]
TYPES = ("A1", "A2", "A3", "multiple", "judge", "fill")
LEVELS = ("easy", "medium", "hard")


def flattened(chapters: DataFrame, labels: dict[str, str]) -> DataFrame:
    """chapters (subject, chapter, questions: array of ID, type, stem, options(label, content), answer, explanation) as rows."""
    rows = chapters.select("subject", "chapter", F.posexplode("questions").alias("at", "q"))
    options = F.transform("q.options", lambda o: F.concat(o["label"], F.lit(". "), o["content"]))
    return rows.select("subject", "chapter", "at", F.col("q.ID").alias("id"), question_type(F.coalesce("q.type", F.lit("")), F.coalesce("q.answer", F.lit("")), labels).alias("type"), F.col("q.stem").alias("question"), options.alias("options"), F.col("q.answer").alias("answer"), F.col("q.explanation").alias("explanation"))


def numbered(texts: DataFrame, answer_mark: str = "Answer:") -> DataFrame:
    """Rows (id, text) of raw text as questions: blocks that begin with a number and a full stop, lettered options, an answer line."""
    parts = F.filter(F.split("text", r"\n(?=[0-9]{1,4}\. )"), lambda b: b.rlike(r"^\s*[0-9]{1,4}\. "))
    rows = texts.select("id", F.posexplode(parts).alias("at", "block"))
    lines = F.transform(F.split("block", "\n"), strip)
    number = F.regexp_extract("block", r"^\s*([0-9]{1,4})\. ", 1).cast("int")
    stem = F.regexp_replace(F.get(lines, F.lit(0)), r"^[0-9]{1,4}\. ", "")
    options = F.filter(lines, lambda x: x.rlike(r"^[A-Z]\. "))
    answer = F.get(F.filter(lines, lambda x: x.startswith(answer_mark)), F.lit(0))
    answer = strip(F.substring(answer, len(answer_mark) + 1, 1000))
    return rows.select("id", "at", number.alias("number"), stem.alias("question"), options.alias("options"), answer.alias("answer"), F.when(F.coalesce(answer, F.lit("")) == "", "no answer").otherwise("").alias("issue"))


def recovered(rows: DataFrame) -> DataFrame:
    """One missing option, left at the end of the stem, is moved to the options; `repaired` says so. No text is made up.

    Guards: 2 to 25 labelled, sorted options; one letter missing up to the next; it stands once in the stem, between
    white space and a word; 4 characters of stem stay; the moved text is 1 to 500 characters on one line.
    """
    seen = F.transform("options", lambda o: F.regexp_extract(o, r"^([A-Z])\. ", 1))
    wanted = F.slice(F.array(*map(F.lit, LETTERS)), F.lit(1), F.size("options") + 1)
    lacking = F.array_except(wanted, seen)
    letter = F.get(lacking, F.lit(0))
    parts = F.split("question", F.concat(F.lit(r"\s"), letter, F.lit(r"[. ]\s*(?=\p{L})")))
    moved = strip(F.get(parts, F.lit(1)))
    fits = (
        F.size("options").between(2, 25)
        & F.forall(seen, lambda x: x != "")
        & (F.array_sort(F.array_distinct(seen)) == seen)
        & (F.size(lacking) == 1)
        & (F.size(parts) == 2)
        & (F.char_length(F.get(parts, F.lit(0))) >= 4)
        & F.char_length(moved).between(1, 500)
        & ~moved.rlike(r"[\n.;!?。；！？]|\s[A-Z]\. ")
    )
    fits = F.coalesce(fits, F.lit(False))
    return rows.withColumns({"repaired": fits, "options": F.when(fits, F.array_sort(F.concat("options", F.array(F.concat(letter, F.lit(". "), moved))))).otherwise(F.col("options")), "question": F.when(fits, strip(F.get(parts, F.lit(0)))).otherwise(F.col("question"))})


def rule_errors() -> Column:
    """All rules a question row breaks, in order; null lists are empty, null options blank. Columns: id, subject, question, answer, type, difficulty, options, tags, knowledge_points."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    choice, fill = F.coalesce(F.col("type").isin("A1", "A2", "A3", "multiple"), F.lit(False)), F.col("type").eqNullSafe("fill")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    options = F.transform(listed("options"), lambda o: F.coalesce(o, F.lit("")))
    letters = F.filter(F.split(F.regexp_replace(F.upper(F.coalesce("answer", F.lit(""))), r"[\s,;、，；]", ""), ""), lambda x: x != "")
    n = F.size(options)
    known = F.slice(F.array(*map(F.lit, LETTERS)), F.lit(1), F.greatest(n, F.lit(0)))
    seen = F.filter(F.transform(options, lambda o: F.regexp_extract(o, r"^([A-Z])[. ]", 1)), lambda x: x != "")
    marks = F.transform(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    rules = [
        *((blank(c), f"missing {c}") for c in ("id", "subject", "question", "answer")),
        (F.size(F.array_distinct(listed("knowledge_points"))) > 3, "too many knowledge points"),
        (F.size(listed("tags")) > 3, "too many tags"),
        (~F.coalesce(F.col("type"), F.lit("")).isin(*TYPES), "unknown type"),
        (~F.coalesce(F.col("difficulty"), F.lit("medium")).isin(*LEVELS), "unknown difficulty"),
        (fill & ((F.size(marks) == 0) | (marks != F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(marks))))), "blanks not consecutive"),
        (fill & (n > 0), "options in a blank question"),
        (choice & (n < 2), "fewer than two options"),
        (choice & ~blank("answer") & (F.size(F.array_except(letters, known)) > 0), "answer outside options"),
        (choice & (F.size(F.array_distinct(letters)) != F.size(letters)), "repeated answer letters"),
        (choice & (F.col("type") != "multiple") & (F.size(letters) > 1), "several answers"),
        (choice & F.exists(options, lambda o: F.regexp_replace(o, r"^[A-Z][. ]\s*", "") == ""), "empty option"),
        (choice & (F.size(seen) > 0) & (seen != F.slice(known, F.lit(1), F.greatest(F.size(seen), F.lit(0)))), "labels out of order"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))


def validated(rows: DataFrame) -> DataFrame:
    """rows with `errors`, also of ids that several rows have."""
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    return rows.withColumn("errors", F.concat(rule_errors(), F.when(F.col("id").isNotNull() & twice, F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>"))))


def prompt() -> Column:
    """Case, stem and options, one per line. Columns: case_info, question, options."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.concat_ws("\n", some("case_info"), some("question"), F.nullif(F.array_join("options", "\n"), F.lit("")))


def sub_queries(stem: Column, answer: Column, kind: Column, chars: int = 500) -> Column:
    """Up to three texts to search for: stem and answer, the answer, and a case's longest sentence."""
    whole = F.trim(F.concat_ws(" ", F.substring(stem, 1, chars), answer))
    longest = F.get(F.sort_array(F.transform(F.split(stem, r"[.!?。！？]"), lambda s: F.struct(F.char_length(F.trim(s)).alias("n"), F.substring(F.trim(s), 1, 220).alias("s"))), asc=False), F.lit(0))["s"]
    more = F.when(kind.isin("A2", "A3"), F.array(whole, answer, longest)).otherwise(F.array(whole))
    return F.slice(F.array_distinct(F.filter(more, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), 1, 3)


def tidy_tags(tags: Column) -> Column:
    return limited_list(tags, 3, 24)


def tidy_points(points: Column) -> Column:
    return limited_list(points, 3, 60)


def block_id(at: Column, *parts: Column) -> Column:
    """Ordinal and six digits of a hash of the block's content."""
    return F.concat(F.lit("b"), at.cast("string"), F.lit("-"), F.substring(F.sha1(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 6))


def markdown(blocks: Column) -> Column:
    """Blocks (section, type, title, text, items, columns, rows) as markdown, with a heading where the section changes."""
    before = F.concat(F.array(F.lit("")), F.transform(blocks, lambda b: b["section"]))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def one(b: Column, i: Column) -> Column:
        head = F.when(F.get(before, i) != b["section"], F.concat(F.lit("### "), b["section"], F.lit("\n\n"))).otherwise("")
        title = F.when(F.coalesce(b["title"], F.lit("")) != "", F.concat(F.lit("**"), b["title"], F.lit("**\n\n"))).otherwise("")
        rule = line(F.transform(b["columns"], lambda c: F.lit("---")))
        table = F.concat_ws("\n", line(b["columns"]), rule, F.array_join(F.transform(b["rows"], line), "\n"))
        body = F.when(b["type"] == "list", F.array_join(F.transform(b["items"], lambda x: F.concat(F.lit("- "), x)), "\n")).when(b["type"] == "table", table).when(b["type"] == "callout", F.concat(F.lit("> "), F.coalesce(b["text"], F.lit("")))).otherwise(F.coalesce(b["text"], F.lit("")))
        return F.concat(head, title, body)

    return F.array_join(F.transform(blocks, one), "\n\n")


def from_markdown(text: Column) -> Column:
    """Sections of markdown (level-3 headings) as blocks (section, text)."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=### )"), lambda p: p.startswith("### "))
    return F.transform(parts, lambda p: F.struct(one_line(F.regexp_extract(p, r"^### ([^\n]*)", 1), 80).alias("section"), strip(F.regexp_replace(p, r"^### [^\n]*", "")).alias("text")))


def batches(rows: DataFrame, size: int, order: str, within: list[str]) -> DataFrame:
    """`batch` number of each row: groups of `size` in order, inside the given columns."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*within).orderBy(order)) - 1) / size))

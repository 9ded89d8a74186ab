"""Review gates: the first reason why a generated row cannot pass unseen, histograms, and a memo of decisions.

Nulls shut a gate: a field that a rule needs and that is null breaks the rule. Only null warnings, grades of quick review
and one of the two lists of tags count as empty. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import duty

SECTIONS = ("analysis", "answerBasis", "pitfalls", "clinicalNotes")
KINDS = ("paragraph", "list", "table", "callout")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _plain(c: str | Column) -> Column:
    """Without white space around it; null is blank."""
    return F.regexp_replace(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), r"^\s+|\s+$", "")


def quick_reason(least: float, corrupt: Column | None = None) -> Column:
    """The first of the ordered reasons, or ''. Columns: pipeline_status, review_status, generation_mode, error_message,
    match_score, explanation, grade, warnings (array), blocks (array of section, type), tags, suggested, brief,
    evidence (array of book, printed_page, quote, score). corrupt: whether the stored structure could not be read."""
    m = min(0.99, max(0.5, least))
    blank = lambda c: _plain(c) == ""
    sections = F.transform("blocks", lambda b: b["section"])
    good = F.exists("evidence", lambda e: ~blank(e["book"]) & (F.coalesce(e["printed_page"], F.lit(0)) > 0) & (F.char_length(_plain(e["quote"])) >= 20) & (e["score"] >= m))
    return duty(
        [
            (~((F.col("pipeline_status") == "generated") & (F.col("review_status") == "pending")), "state"),
            (F.col("generation_mode") != "textbook", "mode"),
            (~blank(F.col("error_message")), "error"),
            (F.coalesce(F.col("match_score"), F.lit(0.0)) < m, "score"),
            (F.char_length(_plain("explanation")) < 80, "short"),
            *([] if corrupt is None else [(corrupt, "corrupt")]),
            (F.upper(F.coalesce(F.nullif("grade", F.lit("")), F.lit("A"))) != "A", "grade"),
            (F.size(_list("warnings")) > 0, "warnings"),
            (F.col("blocks").isNull() | (F.size("blocks") == 0), "no blocks"),
            (F.exists("blocks", lambda b: ~b["section"].isin(*SECTIONS) | ~b["type"].isin(*KINDS)), "unknown block"),
            (F.size(F.array_except(F.array(*map(F.lit, SECTIONS[:3])), sections)) > 0, "sections"),
            (~F.exists("blocks", lambda b: (b["section"] == "pitfalls") & (b["type"] == "table")), "no table"),
            (F.size(F.filter(F.concat(_list("tags"), _list("suggested")), lambda t: ~blank(t))) == 0, "no tags"),
            (blank(F.col("brief")), "no brief"),
            (F.size("evidence") == 0, "no evidence"),
            (~good, "weak evidence"),
        ]
    )


def histogram(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def memoised(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on rows (id, fingerprint, reason, review_status) with the memo of a former run (id, fingerprint, decision, reason).

    A pending row approved before and unchanged since was sent back by hand and stays; a pending one that is unchanged
    keeps its reason; the others are approved if they have no reason.
    """
    old = decisions.select("id", F.col("fingerprint").alias("_f"), F.col("decision").alias("_d"), F.col("reason").alias("_r"))
    found = rows.join(old, "id", "left").withColumn("_same", F.coalesce(F.col("_f") == F.col("fingerprint"), F.lit(False)))
    pending = F.col("review_status") == "pending"
    decision = F.when(~pending, "untouched").when(F.col("_same") & (F.col("_d") == "approved"), "returned").when(F.col("_same") & (F.col("_d") == "pending"), "pending").when(F.col("reason") == "", "approved").otherwise("pending")
    reason = F.when(F.col("_same") & (F.col("_d") == "pending"), F.col("_r")).otherwise(F.col("reason"))
    return found.select("id", "fingerprint", decision.alias("decision"), F.when(decision == "returned", "sent back").otherwise(reason).alias("reason"))


def repair_reason(general: Column) -> Column:
    """Why a generated row without tags cannot be repaired, or ''. Columns: explanation, blocks, evidence."""
    text = F.trim(F.coalesce("explanation", F.lit("")))
    sections = F.transform(F.coalesce("blocks", F.array().cast("array<struct<section:string,type:string>>")), lambda b: b["section"])
    lacks = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), sections)) > 0
    return duty(
        [
            (text == "", "blank"),
            (text.startswith("{"), "raw dump"),
            (F.coalesce(F.size("blocks"), F.lit(0)) == 0, "no blocks"),
            (general & lacks("answerBasis", "pitfalls"), "sections"),
            (~general & lacks("analysis", "answerBasis", "pitfalls"), "sections"),
            (~F.exists("blocks", lambda b: (b["section"] == "pitfalls") & (b["type"] == "table")), "no table"),
            (~general & (F.size("evidence") == 0), "no evidence"),
        ]
    )


def auto_reason(quick: Column) -> Column:
    """Quick reasons first, then those of unattended approval. Further columns: errors (array of broken rules), bank,
    manual, type, answer, n_options."""
    letters = F.filter(F.split(F.regexp_replace(F.upper(F.coalesce("answer", F.lit(""))), r"[\s,;]", ""), ""), lambda x: x != "")
    known = F.slice(F.array(*(F.lit(chr(65 + i)) for i in range(26))), F.lit(1), F.greatest(F.col("n_options"), F.lit(0)))
    choice = F.col("type").isin("A1", "A2", "A3", "multiple")
    return duty(
        [
            (quick != "", "quick review"),
            (F.isnan("match_score") | (F.abs("match_score") == float("inf")), "score not finite"),
            (F.coalesce("grade", F.lit("")) != "A", "grade not stated"),
            (F.size("errors") > 0, "broken rules"),
            (~F.col("bank").isin("school", "kaoyan"), "unknown bank"),
            (F.col("manual"), "manual"),
            (choice & ((F.size(letters) == 0) | (F.size(F.array_except(letters, known)) > 0)), "answer"),
            (choice & (F.col("type") != "multiple") & (F.size(letters) != 1), "several answers"),
        ]
    )


def package_problems() -> Column:
    """All that a generated package lacks. Columns: blocks, evidence, tags, suggested, brief, generation_mode."""
    sections = F.transform("blocks", lambda b: b["section"])
    general = F.col("generation_mode") == "general_knowledge"
    wanted = F.when(general, F.array(F.lit("answerBasis"), F.lit("pitfalls"))).otherwise(F.array(*map(F.lit, SECTIONS[:3])))
    rules = [
        (F.size(F.array_except(wanted, sections)) > 0, "sections"),
        (~F.exists("blocks", lambda b: (b["section"] == "pitfalls") & (b["type"] == "table")), "table"),
        (~general & (F.size("evidence") == 0), "evidence"),
        (F.size(F.concat(_list("tags"), _list("suggested"))) == 0, "tags"),
        (_plain("brief") == "", "brief"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in rules)))

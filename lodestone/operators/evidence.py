"""Choosing evidence: support of sentences for an answer, excerpts and highlights, context, grounding, the best per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, squeezed

# fixed values: marks that end a sentence, and patterns of definitions, contents pages and lines that say nothing
MARKS = "。！？；"
PARTS = r"[\s，。；：、？！“”‘’（）()]+"
ASKS = "是研究|是指|定义|属于|称为"
DEFINES = "研究|是指|称为|即|定义"
CONTENTS = "本章数字资源|目录|第一章|第二章|第三章"
NOISE = r"^(?:第?[一二三四五六七八九十百0-9]+[章节页]?|本章数字资源\s*\d*)$"


def sentences(text: Column, marks: str = MARKS) -> Column:
    """Stripped sentences, each with its mark; a text without marks is one."""
    found = F.regexp_extract_all(text, F.lit(f"[^{marks}]+[{marks}]?"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def stem_terms(stem: Column) -> Column:
    return F.filter(F.split(stem, PARTS), lambda t: F.char_length(t).between(2, 24))


def support(sentence: Column, answers: Column, units: Column, terms: Column, asks: Column) -> Column:
    """120 for each answer verbatim, up to 90 for its bigrams, up to 8 for each part of the stem that occurs; 18 for a
    sentence that defines where the stem asks for a definition; 12 less for contents pages without an answer.

    units: the answers' bigrams; terms: stem_terms() of the stem; asks: whether it asks for a definition.
    """
    mine = bigrams(sentence)
    held = F.filter(answers, lambda a: (a != "") & F.contains(sentence, a))
    share = F.aggregate(units, F.lit(0.0), lambda acc, u: acc + F.when(F.size(u) == 0, 0.0).otherwise(F.size(F.array_intersect(u, mine)) / F.size(u)))
    words = F.aggregate(F.filter(terms, lambda t: F.contains(sentence, t)), F.lit(0), lambda acc, t: acc + F.least(F.lit(8), F.char_length(t)))
    defined = F.when(asks & sentence.rlike(DEFINES), 18.0).otherwise(0.0)
    listed = F.when(sentence.rlike(CONTENTS) & (F.size(held) == 0), 12.0).otherwise(0.0)
    return F.when(sentence == "", 0.0).otherwise(F.round(F.size(held) * 120.0 + 90 * share + words + defined - listed, 6))


def asked(rows: DataFrame) -> DataFrame:
    """rows (answers, stem) with what support() needs of them, made once a row: _units, _terms, _asks."""
    return rows.withColumns({"_units": F.transform("answers", bigrams), "_terms": stem_terms(F.col("stem")), "_asks": F.col("stem").rlike(ASKS)})


def _support(sentence: Column) -> Column:
    return support(sentence, F.col("answers"), F.col("_units"), F.col("_terms"), F.col("_asks"))


def scored_sentences(chunks: DataFrame, queries: DataFrame, keep: tuple[str, ...] = (), marks: str = MARKS) -> DataFrame:
    """query_id, chunk_id, at, sentence, support for every sentence of the queries' chunks, with the columns to keep.

    chunks: query_id, chunk_id, chunk_text; queries: query_id, answers (list), stem. Null and blank texts have none.
    """
    rows = chunks.select("query_id", "chunk_id", *keep, F.posexplode(sentences(squeezed(F.col("chunk_text")), marks)).alias("at", "sentence"))
    return rows.join(asked(queries.select("query_id", "answers", "stem")), "query_id").withColumn("support", _support(F.col("sentence"))).drop("answers", "stem", "_units", "_terms", "_asks")


def _first_best(scores: Column) -> Column:
    """The place, from 1, of the greatest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def excerpts(rows: DataFrame, marks: str = MARKS, chars: int = 240, context: int = 320, most: int = 8) -> DataFrame:
    """rows (quote, answers, stem, question) with excerpt, highlights, context and support, that of the best sentence; optional columns model_excerpt and
    model_highlights are a model's proposals.

    The excerpt is the best sentence of the quote, cut to `chars`, or the proposed one if it stands in the quote and no
    sentence supports the answer better. Highlights are proposals, answers and parts of the question that stand in it.
    The context is the best sentence of the quote's telling lines with its neighbours, cut to `context`.
    """
    given = F.col("model_excerpt") if "model_excerpt" in rows.columns else F.lit("")
    marked = F.coalesce("model_highlights", F.array().cast("array<string>")) if "model_highlights" in rows.columns else F.array().cast("array<string>")
    rows = asked(rows).withColumn("_quote", squeezed(F.coalesce("quote", F.lit("")))).withColumn("_given", squeezed(F.coalesce(given, F.lit(""))))
    rows = rows.withColumn("_given", F.when(F.contains("_quote", F.col("_given")), F.col("_given")).otherwise("")).withColumn("_all", sentences(F.col("_quote"), marks))
    rows = rows.withColumn("_scores", F.transform("_all", _support))
    top = F.get("_all", _first_best(F.col("_scores")) - 1)
    own = F.coalesce(F.substring(top, 1, chars), F.lit(""))
    better = (F.col("_given") == "") | (F.array_max("_scores") > _support(F.col("_given")))
    rows = rows.withColumn("excerpt", F.when(F.size("_all") == 0, F.when(F.col("_given") == "", F.substring("_quote", 1, chars)).otherwise(F.col("_given"))).when(better, own).otherwise(F.col("_given")))
    named = F.filter(F.transform(F.split("question", PARTS), lambda t: F.trim(F.regexp_replace(t, "^[A-E][.、．:]?", ""))), lambda t: F.char_length(t).between(2, 24))
    wanted = F.transform(F.concat(marked, F.filter("answers", lambda a: a != ""), named), squeezed)
    holds = lambda t: F.char_length(t).between(2, 120) & F.contains(F.col("excerpt"), t) & F.contains(F.col("_quote"), t)
    rows = rows.withColumn("highlights", F.slice(F.array_distinct(F.filter(wanted, holds)), 1, most))
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("quote", F.lit("")), "\r", "\n"), "\n"), lambda x: F.btrim(squeezed(x), F.lit(" \t|·"))), lambda x: (x != "") & ~x.rlike(NOISE))
    rows = rows.withColumn("_clean", F.when(F.size(lines) > 0, squeezed(F.array_join(lines, " "))).otherwise(F.col("_quote"))).withColumn("_told", sentences(F.col("_clean"), marks))
    at = _first_best(F.transform("_told", _support))
    near = F.array_join(F.slice("_told", F.greatest(F.lit(1), at - 1), F.when(at == 1, 2).otherwise(3)), "")
    only = F.coalesce(F.substring(F.get("_told", F.lit(0)), 1, chars), F.substring("_clean", 1, chars))
    place = F.position(only, F.col("_clean"))
    start = F.greatest(F.lit(0), place - 81)
    single = F.when(place == 0, F.substring("_clean", 1, context)).otherwise(F.substring(F.col("_clean"), start + 1, place - 1 + F.char_length(only) + 160 - start))
    rows = rows.withColumn("support", F.array_max("_scores")).withColumn("context", F.substring(squeezed(F.when(F.size("_told") > 1, near).otherwise(single)), 1, context))
    return rows.drop("_units", "_terms", "_asks", "_quote", "_given", "_all", "_scores", "_clean", "_told")


def grounded(candidate: Column, source: Column, share: float = 0.55, least: int = 20) -> Column:
    """Long enough, most of its bigrams in the source, and all of its numbers there."""
    mine = bigrams(candidate)
    numbers = F.regexp_extract_all(candidate, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))
    covered = F.size(F.array_intersect(mine, bigrams(source))) >= F.size(mine) * share
    return (F.char_length(candidate) >= least) & (F.size(mine) > 0) & covered & F.forall(numbers, lambda n: F.contains(source, n))


def grounded_context(proposed: Column, quote: Column, context: Column) -> Column:
    """A model's summary of the quote, cut to 500 characters, if it is grounded; else the local context."""
    candidate = F.substring(squeezed(F.coalesce(proposed, F.lit(""))), 1, 500)
    return F.when(grounded(candidate, squeezed(quote)), candidate).otherwise(context)


def best_evidence(rows: DataFrame, most: int = 4) -> DataFrame:
    """Rows (query_id, book, version, chunk_id, support, score, at) by support, then score, then place: the first always,
    others if they have support and a score of 0.55, or 0.15 below the best, at least; one of each book and version."""
    order = [F.desc("support"), F.desc("score"), F.col("at")]
    rows = rows.withColumns({"_r": F.row_number().over(Window.partitionBy("query_id").orderBy(*order)), "_best": F.max("score").over(Window.partitionBy("query_id"))})
    rows = rows.where((F.col("_r") == 1) | ((F.col("support") > 0) & (F.col("score") >= F.greatest(F.lit(0.55), F.round(F.col("_best") - 0.15, 9)))))
    rows = rows.withColumn("_b", F.row_number().over(Window.partitionBy("query_id", "book", "version").orderBy(*order))).where("_b = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)
    return rows.withColumn("evidence_id", F.concat(F.lit("E"), F.col("rank").cast("string"))).drop("_r", "_best", "_b")

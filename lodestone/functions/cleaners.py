"""Clean-up of nested fields, names, addresses and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, key, one_line, strip


def filled(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""


def first_by(items: Column, same) -> Column:
    """Keeps the first of array items for which same(a, b) holds, in order."""
    return F.aggregate(items, F.filter(items, lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: same(y, x)), acc).otherwise(F.concat(acc, F.array(x))))


def study_points(points: Column, most: int = 3) -> Column:
    """Points (title, body): blank ones go, of equal titles the first stays, at most `most`."""
    tidy = F.transform(points, lambda p: F.struct(one_line(p["title"], 60).alias("title"), clean(p["body"], 1000).alias("body")))
    return F.slice(first_by(F.filter(tidy, lambda p: (p["title"] != "") & (p["body"] != "")), lambda a, b: F.lower(a["title"]) == F.lower(b["title"])), 1, most)


def memory_cards(cards: Column, blocked: Column, most: int = 3) -> Column:
    """Cards (title, content, cue, contrast): blank or blocked content goes, of equal content the first stays."""
    tidy = F.transform(cards, lambda c: F.struct(one_line(c["title"], 60).alias("title"), clean(c["content"], 500).alias("content"), clean(c["cue"], 200).alias("cue"), clean(c["contrast"], 200).alias("contrast")))
    keys = F.transform(blocked, key)
    kept = F.filter(tidy, lambda c: (c["title"] != "") & (c["content"] != "") & ~F.array_contains(keys, key(c["content"])))
    return F.slice(first_by(kept, lambda a, b: key(a["content"]) == key(b["content"])), 1, most)


def evidence_items(items: Column, most: int = 10, highlights: int = 8) -> Column:
    """Evidence (book, quote, excerpt, page, score, highlights): with a quote, or else an excerpt, and bounded lists."""
    return F.slice(
        F.filter(
            F.transform(items, lambda e: F.struct(one_line(F.coalesce(e["book"], F.lit("")), 200).alias("book"), clean(F.coalesce(F.nullif(strip(e["quote"]), F.lit("")), e["excerpt"], F.lit("")), 2000).alias("quote"), F.when(e["page"] > 0, e["page"]).alias("page"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["score"], F.lit(0.0)))).alias("score"), F.slice(F.filter(e["highlights"], filled), 1, highlights).alias("highlights"))),
            lambda e: e["quote"] != "",
        ),
        1,
        most,
    )


def trace(steps: Column, most: int = 20) -> Column:
    return F.slice(F.transform(steps, lambda s: F.struct(one_line(s["stage"], 40).alias("stage"), F.greatest(F.lit(0), F.coalesce(s["tokens"], F.lit(0))).alias("tokens"))), 1, most)


def options(c: Column) -> Column:
    """Options from a JSON list, or text parted by | or line ends."""
    listed = F.from_json(c, "array<string>")
    parts = F.coalesce(listed, F.split(c, r"\||\n"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def edition(name: Column, numerals: str = "一二三四五六七八九") -> Column:
    """The edition's number in a name: digits, or numerals of the caller's language up to 99, before the word for it."""
    ten, mark = "十", "[版e]"
    digits = F.regexp_extract(name, rf"([0-9]{{1,2}})\s*(?:st|nd|rd|th)?\s*{mark}", 1)
    words = F.regexp_extract(name, rf"([{numerals}{ten}]{{1,3}})\s*版", 1)
    digit = lambda x: F.when(x == "", F.lit(None)).otherwise(F.instr(F.lit(numerals), x))
    before, after = F.regexp_extract(words, rf"^(.?){ten}", 1), F.regexp_extract(words, rf"{ten}(.?)$", 1)
    composed = F.when(F.contains(words, F.lit(ten)), F.coalesce(digit(before), F.lit(1)) * 10 + F.coalesce(digit(after), F.lit(0))).otherwise(digit(words))
    return F.when(digits != "", digits.cast("int")).when(words != "", composed.cast("int"))


def inferred(name: Column, subjects: list[str]) -> tuple[Column, Column]:
    """(subject, warning): the longest known subject inside a file name, or none."""
    found = [F.when(F.contains(name, F.lit(s)), F.lit(s)) for s in sorted(subjects, key=lambda s: (-len(s), s))]
    subject = F.coalesce(*found)
    return subject, F.when(subject.isNull(), "subject unknown").when(edition(name).isNull(), "edition unknown").otherwise("")


def safe_name(c: Column, chars: int = 80) -> Column:
    """A file name without separators, reserved marks or control characters."""
    kept = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(kept == "", "unnamed").otherwise(F.substring(kept, 1, chars))


def service_address(c: Column) -> Column:
    """A service's base address: no white space, closing slashes or known endpoint paths."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"/+$", ""), r"/(chat/completions|embeddings|rerank)$", "")


def redacted(c: Column, chars: int = 300) -> Column:
    """A message without keys and bearer tokens, on one line."""
    return one_line(F.regexp_replace(F.regexp_replace(c, r"(?i)bearer\s+\S+", "Bearer ***"), r"\b(sk|key)-[A-Za-z0-9]{8,}", "***"), chars)


def retry_after(c: Column, now: Column) -> Column:
    """Seconds to wait, from a header of seconds or an HTTP date; null where it is neither."""
    seconds = F.try_to_number(F.when(c.rlike(r"^\s*[0-9]{1,6}\s*$"), F.trim(c)), F.lit("999999")).cast("double")
    moment = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(seconds, F.when(moment.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(moment) - F.unix_timestamp(now)).cast("double"))))


def salvaged(c: Column) -> Column:
    """The outermost JSON object inside noisy text, or null."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def error_summary(c: Column, rules: dict[str, str]) -> Column:
    """The first rule (pattern: summary) that a message matches, else its first line."""
    out = None
    for pattern, summary in rules.items():
        out = F.when(c.rlike(pattern), summary) if out is None else out.when(c.rlike(pattern), summary)
    last = one_line(F.element_at(F.split(F.coalesce(c, F.lit("")), "\n"), 1), 120)
    return last if out is None else out.otherwise(last)


def answer_focus(prompt: Column, answer: Column, lines: int = 3) -> Column:
    """The texts of the options that an answer's letters name, then the first lines of the stem."""
    letters = F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit("[A-Z]"), F.lit(0)))
    all_lines = F.transform(F.split(prompt, "\n"), strip)
    listed = F.filter(all_lines, lambda x: x.rlike(r"^[A-Z][.．、] ?"))
    named = F.transform(F.filter(listed, lambda x: F.array_contains(letters, F.substring(x, 1, 1))), lambda x: F.regexp_replace(x, r"^[A-Z][.．、] ?", ""))
    stem = F.slice(F.filter(all_lines, lambda x: (x != "") & ~x.rlike(r"^[A-Z][.．、] ?")), 1, lines)
    return F.concat(named, stem)


def margin_numbers(lines: Column, share: float = 0.1) -> Column:
    """Numbers that stand alone on a line in the first or last tenth of a page's lines."""
    n = F.size(lines)
    edge = F.greatest(F.lit(1), F.ceil(n * share).cast("int"))
    ends = F.concat(F.slice(lines, F.lit(1), edge), F.slice(lines, F.greatest(F.lit(1), n - edge + 1), edge))
    return F.array_distinct(F.transform(F.filter(ends, lambda x: x.rlike(r"^\s*[0-9]{1,4}\s*$")), lambda x: F.trim(x).cast("int")))


def sampled_pages(n: Column, triples: int = 20) -> Column:
    """Up to 60 pages of a file, as triples of neighbours spread over it."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(triples - 1)), lambda i: F.rint(i * F.greatest(F.lit(0), n - 3) / (triples - 1)).cast("int") + 1)
    return F.filter(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))), lambda p: p <= n)


def needs_ocr(overlap: Column, invalid_share: Column, image_share: Column, n_chars: Column, drawings: Column) -> Column:
    """Whether a page's text layer is of no use."""
    return overlap | (invalid_share > 0.02) | ((image_share > 0.6) & (n_chars < 80)) | ((n_chars == 0) & (drawings > 0))

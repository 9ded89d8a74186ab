"""Column expressions over text: tokens, list clean-up, plain text, question fields. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\u4e00-\u9fff]|[a-z]+|\p{Nd}+(?:\.\p{Nd}+)?"
# fixed values: words of a question that say nothing about its subject
STOP = (
    "题型 型题 单句 最佳 选择 选项 答案 正确 错误 有关 关于 下列 以下 其中 描述 说法 关系 的是 一个 一种 主要 可以 可能 应该 应当 属于 不属于 "
    "a b c d e f 的 了 于 与 和 或 及 中 是 为 在 有 无 可 使 由 对 最 全"
).split()
SPACES = " \t\n\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def clean(c: Column, limit: int) -> Column:
    """Stripped, with line ends as \\n, cut to `limit` characters."""
    return F.substring(F.regexp_replace(strip(c), "\r\n|\r", "\n"), 1, limit)


def one_line(c: Column, limit: int) -> Column:
    return F.substring(F.regexp_replace(strip(c), "[ \t\n\f\r]+", " "), 1, limit)


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain(c: Column) -> Column:
    """HTML or light markup as text: <br> becomes a line end, other tags go."""
    return strip(F.regexp_replace(F.regexp_replace(c, "(?i)<br */?>", "\n"), "<[^>]*>", ""))


def tokens(c: Column) -> Column:
    """Single Han characters, Latin words in lower case, and numbers with their decimals."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def query_terms(c: Column, stop: Sequence[str] = STOP, most: int = 16) -> Column:
    """The first `most` distinct tokens that are no stop words, in order of appearance."""
    found = F.array_distinct(tokens(c))
    if stop:
        found = F.filter(found, lambda t: ~t.isin(*stop))
    return F.slice(found, 1, most)


def bigrams(c: Column) -> Column:
    """Distinct neighbouring pairs of a text's ASCII letters and digits and Han characters, case folded."""
    kept = F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^0-9a-z\u4e00-\u9fff]+", "")
    return F.array_distinct(F.regexp_extract_all(kept, F.lit("(?=(..))"), F.lit(1)))  # a lambda would fold the text again for each pair


def key(c: Column) -> Column:
    """Folded form under which tags are the same: lower case, full-width forms narrowed, no white space or . _ - ·"""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.lower(F.translate(c, wide + "　", narrow + " ")), r"[\s·._\-]+", "")


def dedupe(items: Column) -> Column:
    """Keeps the first of items that are equal but for case, in order."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def limited_list(c: Column, most: int, chars: int, least: int = 2, separators: str = "[,，、;；|\n]") -> Column:
    """A delimited text as a list: parts of `least` characters or more, cut to `chars`, first of equal ones, at most `most`."""
    parts = F.filter(F.transform(F.split(c, separators), lambda x: F.substring(strip(x), 1, chars)), lambda x: F.char_length(x) >= least)
    return F.slice(dedupe(parts), 1, most)


def fill_answers(c: Column) -> Column:
    """JSON of a list of blanks, each a list of accepted texts; one bad blank empties the whole."""
    found = F.from_json(c, "array<array<string>>")
    tidy = F.transform(found, lambda b: F.filter(F.transform(b, strip), lambda x: x != ""))
    return F.when(found.isNull() | F.exists(tidy, lambda b: b.isNull() | (F.size(b) == 0)), F.array().cast("array<array<string>>")).otherwise(tidy)


def question_type(kind: Column, answer: Column, labels: dict[str, str]) -> Column:
    """Normalised type; `labels` maps words of the caller's language to types and is tried in order."""
    letters = F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit("[A-E]"), F.lit(0)))
    out = F.when(F.upper(kind).isin("A1", "A2", "A3"), F.upper(kind)).when(F.lower(kind).isin("fill", "multiple", "judge"), F.lower(kind))
    for word, name in labels.items():
        out = out.when(F.contains(F.lower(kind), F.lit(word)), name)
    return out.otherwise(F.when(F.size(letters) > 1, "multiple").otherwise("A1"))


def latex_tidy(c: Column) -> Column:
    """Recognised text: \\text{} wrappers opened, $n$ page numbers bare, runs of blank lines closed."""
    opened = F.regexp_replace(c, r"\\text\{([^}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(opened, r"\$([0-9]+)\$", "$1"), r"\n{3,}", "\n\n")

"""Where to search: subjects with their aliases, libraries in and beside a subject, clues of a case, texts to search for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeezed
from .retrieval import aliased

# fixed values: kinds of clues and the words that show them; subjects that stand in for each other; aliases
CLUES = {
    "检验影像": "(?i)检查|检验|化验|血|尿|CT|MRI|超声|X线|提示|显示|升高|降低|阳性|阴性",
    "病程体征": "(?i)患者|病人|主诉|病史|病程|查体|体征|疼痛|发热|咳|呕|腹泻|水肿|意识",
    "既往用药": "(?i)既往|患有|服用|给予|用药|治疗|剂量|过敏|手术史",
}
CORE = "题目核心"
GROUPS = (
    ("药理学", "临床药理学", "药物治疗学", "内科学"),
    ("病理学", "病理生理学", "内科学", "诊断学"),
    ("生理学", "病理生理学", "内科学"),
    ("外科学", "解剖学", "影像诊断学", "诊断学"),
    ("妇产科学", "儿科学", "内科学", "诊断学"),
)
ALIASES = {"外基": "外科学", "外科": "外科学", "外科学基础": "外科学"}
ENDS = r"[。；;！？!?\n]"


def case_clues(*texts: Column, kinds: Mapping[str, str] = CLUES) -> Column:
    """(label, text) for each kind of clue that a sentence shows: the longest such sentence, the first of equal ones, cut
    to 220 characters. Null texts count as empty; sentences beyond 180 characters are equally long."""
    whole = F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in texts))
    parts = F.filter(F.transform(F.split(whole, ENDS), squeezed), lambda s: s != "")

    def best(label: str, pattern: str) -> Column:
        shown = F.filter(parts, lambda s: s.rlike(pattern))
        sizes = F.transform(shown, lambda s: F.least(F.char_length(s), F.lit(180)))
        found = F.get(shown, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)
        return F.when(F.size(shown) > 0, F.struct(F.lit(label).alias("label"), F.substring(found, 1, 220).alias("text")))

    return F.slice(F.array_compact(F.array(*(best(k, v) for k, v in kinds.items()))), 1, 3)


def search_texts(kind: Column, question: Column, prompt: Column, answer: Column, options: Column, clues: Column) -> Column:
    """Up to three (label, text) to search for: the stem with its keyed option, and for a case each clue with it.

    A case has the type A2, A3 or A4, or none and some clue. options: texts that begin with their letter and a mark.
    """
    stem = F.substring(F.coalesce(F.nullif(question, F.lit("")), prompt, F.lit("")), 1, 500)
    own = F.coalesce(answer, F.lit(""))
    keyed = F.filter(F.coalesce(options, F.array().cast("array<string>")), lambda o: (F.length(own) > 0) & F.contains(F.upper(own), F.upper(F.substring(o, 1, 1))) & F.substring(o, 2, 1).isin(".", "、", "．", ":"))
    more = F.array_join(keyed, " ")
    text = lambda t: F.trim(F.concat_ws(" ", t, more))
    core = F.array(F.struct(F.lit(CORE).alias("label"), text(stem).alias("text")))
    case = F.upper(F.coalesce(kind, F.lit(""))).isin("A2", "A3", "A4") | ((F.coalesce(kind, F.lit("")) == "") & (F.size(clues) > 0))
    every = F.when(case, F.concat(core, F.transform(clues, lambda c: F.struct(c["label"].alias("label"), text(c["text"]).alias("text"))))).otherwise(core)
    none = F.array().cast("array<struct<label:string,text:string>>")
    once = F.aggregate(every, none, lambda acc, x: F.when((x["text"] == "") | F.exists(acc, lambda y: y["text"] == x["text"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(case, F.slice(once, 1, 3)).otherwise(core)


def related(spark: SparkSession, groups: Iterable[Iterable[str]] = GROUPS, aliases: Mapping[str, str] = ALIASES, more: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """(subject, other): canonical subjects that may stand in for each other; a table of the configuration's size."""
    pairs = {(a, b) for g in groups for a in g for b in g} | {(a, b) for a, found in (more or {}).items() for b in found}
    rows = spark.createDataFrame(sorted(pairs) or [("", "")], "a string, b string")
    return rows.select(aliased(F.col("a"), aliases).alias("subject"), aliased(F.col("b"), aliases).alias("other")).where("subject <> other AND subject <> ''").distinct()


def usable(libraries: DataFrame) -> DataFrame:
    """Libraries whose files are ready (or warn) and some; a null status or count says nothing against one."""
    return libraries.where("(file_status IS NULL OR file_status IN ('ready', 'warning')) AND (file_count IS NULL OR file_count > 0)")


def routed(questions: DataFrame, libraries: DataFrame, aliases: Mapping[str, str] = ALIASES, beside: DataFrame | None = None, chosen: bool = False) -> DataFrame:
    """(query_id, library_id, role): each question's libraries, `primary` of its own subject, `secondary` beside it.

    questions: query_id, subject; libraries: library_id, subject. chosen: the libraries are a user's selection, so all
    others are secondary; else only those of a related subject are. Distinct subjects are matched, then joined back.
    """
    resolved = questions.select("query_id", aliased(F.col("subject"), aliases).alias("own"))
    held = libraries.select("library_id", aliased(F.col("subject"), aliases).alias("theirs"))
    subjects, kinds = resolved.select("own").distinct(), held.select("theirs").distinct()
    same = subjects.join(kinds, F.col("own") == F.col("theirs")).select("own", "theirs", F.lit("primary").alias("role"))
    if chosen:  # subjects are few; each meets the kinds of the selection by a set difference, not by rows of questions
        lists = kinds.agg(F.collect_set("theirs").alias("all"))
        other = subjects.withColumn("theirs", F.explode(lists.scalar())).where("own <> theirs")
    else:
        table = beside if beside is not None else related(questions.sparkSession, aliases=aliases)
        other = subjects.join(table, F.col("own") == F.col("subject")).join(kinds, F.col("other") == F.col("theirs")).select("own", "theirs").distinct()
    pairs = same.union(other.select("own", "theirs", F.lit("secondary").alias("role")))
    return resolved.join(pairs, "own").join(held, "theirs").select("query_id", "library_id", "role")

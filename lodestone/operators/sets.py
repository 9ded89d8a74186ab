"""Question sets as snapshots: made, grown, edited, listed from the trash, deleted with all that is theirs.

Every function gives new snapshots; nothing is updated in place. Null ids belong to no set and stay. Empty changes leave
a snapshot as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line

ACTIVE = ("queued", "running", "paused")
# fixed values: texts that tell of a result nobody finished
UNFINISHED = "待人工整理|模型输出无法解析"


def appended(sets: DataFrame, questions: DataFrame, new: DataFrame, key: str = "external_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, questions, baselines): new questions (set_id, key and the columns of questions) put into sets that exist, the
    sets' counts told again, and the new rows as their own baselines. A row whose set does not exist is left out, and so
    is one whose key its set has; of several new ones with a key the least stays, by the JSON of the row. Rows without a key
    all stay."""
    fresh = new.join(sets.select("set_id"), "set_id", "left_semi").join(questions.select("set_id", key), ["set_id", key], "left_anti")
    order = Window.partitionBy("set_id", key).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in new.columns))))
    keyed = fresh.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    fresh = keyed.unionByName(fresh.where(F.col(key).isNull()))
    whole = questions.unionByName(fresh.select(*questions.columns))
    return counted(sets, whole), whole, fresh.select(*questions.columns)


def counted(sets: DataFrame, questions: DataFrame) -> DataFrame:
    """sets with question_count as questions tells it."""
    n = questions.groupBy("set_id").agg(F.count("*").alias("_n"))
    return sets.drop("question_count").join(n, "set_id", "left").withColumn("question_count", F.coalesce("_n", F.lit(0))).drop("_n")


def removed(ids: DataFrame, sets: DataFrame, questions: DataFrame, children: dict[str, DataFrame], key: str = "id", child: str = "question_pk") -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The snapshots without the questions of ids (key), without what hangs on them, and with the sets' counts told again."""
    gone = ids.select(key).distinct()
    left = questions.join(gone, key, "left_anti")
    own = gone.select(F.col(key).alias(child))
    return counted(sets, left), left, {name: rows.join(own, child, "left_anti") for name, rows in children.items()}


def referring(jobs: DataFrame, sets: DataFrame, questions: DataFrame) -> DataFrame:
    """(job_id, status, set_id): jobs whose payload (JSON) names one of sets, or a question of it, alone or in a list.

    Payloads that cannot be read name nothing.
    """
    p = F.from_json("payload", "set_id string, question_pk string, question_ids array<string>")
    rows = jobs.select("job_id", "status", p.alias("p"))
    whole = rows.select("job_id", "status", F.col("p.set_id").alias("set_id"))
    ids = F.array_append(F.coalesce("p.question_ids", F.array().cast("array<string>")), F.col("p.question_pk"))
    named = rows.select("job_id", "status", F.explode(ids).alias("x")).select("job_id", "status", F.col("x").try_cast("long").alias("id")).where("id IS NOT NULL")
    by_question = named.join(questions.select("id", "set_id"), "id").select("job_id", "status", "set_id")
    known = sets.select("set_id", F.col("set_id").cast("string").alias("_text"))
    named = whole.union(by_question.withColumn("set_id", F.col("set_id").cast("string"))).withColumnRenamed("set_id", "_text")
    return named.join(known, "_text").select("job_id", "status", "set_id").distinct()


def deletable(jobs: DataFrame, sets: DataFrame, questions: DataFrame) -> DataFrame:
    """(set_id, n_jobs, deletable): a set goes, with its jobs, unless one of them waits, runs or is paused."""
    found = referring(jobs, sets, questions).groupBy("set_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*ACTIVE)).alias("busy"))
    return sets.select("set_id").join(found, "set_id", "left").select("set_id", F.coalesce("n", F.lit(0)).alias("n_jobs"), (F.coalesce("busy", F.lit(0)) == 0).alias("deletable"))


def trash_list(trash: DataFrame, sets: DataFrame, unknown: str = "") -> DataFrame:
    """Trash rows with the name of their set, also where that is gone."""
    return trash.join(sets.select("set_id", F.col("name").alias("set_name")), "set_id", "left").withColumn("set_name", F.coalesce("set_name", F.lit(unknown)))


def next_job(jobs: DataFrame) -> DataFrame:
    """The queued job that waits longest, the one of least id of several: one row, or none."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(1)


def needs_manual(text: Column, matched: Column, package: Column, tagged: Column, brief: Column, sections: Column, tabled: Column, warned: Column) -> Column:
    """Whether a result must be finished by hand: no evidence or text, a package without tags, brief text, a needed section
    or a table of pitfalls, warnings, marks of an unfinished text, or a raw dump of the package; also if that cannot be
    told, because one of these is null."""
    body = F.trim(F.coalesce(text, F.lit("")))
    need = F.array(*map(F.lit, ("analysis", "answerBasis", "pitfalls")))
    lacking = package & (~tagged | ~brief | (F.size(F.array_except(need, F.coalesce(sections, F.array().cast("array<string>")))) > 0) | ~tabled)
    dump = (body.startswith("{") | body.startswith("```json")) & F.contains(body, F.lit('"explanationBlocks"'))
    return F.coalesce(~matched | (body == "") | lacking | warned | body.rlike(UNFINISHED) | dump, F.lit(True))


def card_meta(version: Column, generator: Column, generated_at: Column) -> Column:
    """A card collection's meta: version 1 to 10, generator and time as one line."""
    name = F.coalesce(F.nullif(one_line(generator, 80), F.lit("")), F.lit("analysis-tool"))
    return F.struct(F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.nullif(version, F.lit(0)), F.lit(1)))).alias("schemaVersion"), name.alias("generator"), F.coalesce(one_line(generated_at, 40), F.lit("")).alias("generatedAt"))


def deactivated(libraries: DataFrame, ids: DataFrame) -> DataFrame:
    """Libraries with `active` false for those of ids; nothing of theirs goes."""
    gone = ids.select("library_id").distinct().withColumn("_gone", F.lit(True))
    return libraries.join(gone, "library_id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")

"""Tag catalogs: counting, promotion, renaming, merging, deleting, and rewriting the questions' tag lists.

Questions are rows (set_id, subject, question_id, tags, suggested). The catalog has one row per set, subject and key.
Null lists count as empty; questions without tags stay, with empty lists. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key

ACTIVE, MOST, CHARS = 3, 3, 24


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _all() -> Column:
    return F.concat(_list("tags"), _list("suggested"))


def mentions(questions: DataFrame) -> DataFrame:
    """One row per question and tag key, with its first place and wording in tags then suggested."""
    rows = questions.select("set_id", "subject", "question_id", F.posexplode(_all()).alias("at", "label")).withColumn("key", key(F.col("label"))).where("key <> ''")
    return rows.groupBy("set_id", "subject", "question_id", "key").agg(F.min("at").alias("at"), F.substring(F.min_by("label", "at"), 1, CHARS).alias("label"))


def synced(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, questions): keys used by ACTIVE questions or more are active; lists are rewritten by catalog labels.

    A question's first MOST active keys become tags, its first MOST others suggested. Labels are those of the question
    of least id that uses the key. Rows of one set, subject and id are one question: each gets the tags of all of them.
    """
    found = mentions(questions)
    catalog = found.groupBy("set_id", "subject", "key").agg(F.count("*").alias("usage"), F.min_by("label", "question_id").alias("name"))
    catalog = catalog.withColumn("status", F.when(F.col("usage") >= ACTIVE, "active").otherwise("candidate"))
    placed = found.join(catalog, ["set_id", "subject", "key"]).where("question_id IS NOT NULL")
    lists = placed.groupBy("set_id", "subject", "question_id").agg(F.sort_array(F.collect_list(F.struct("at", "name", "status"))).alias("x"))
    pick = lambda s: F.slice(F.transform(F.filter("x", lambda t: t["status"] == s), lambda t: t["name"]), 1, MOST)
    keys = ["set_id", "subject", "question_id"]
    made = lists.select(*(F.col(k).alias(f"_{k}") for k in keys), pick("active").alias("tags"), pick("candidate").alias("suggested"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    whole = questions.drop("tags", "suggested").join(made, same, "left").drop(*(f"_{k}" for k in keys))
    return catalog, whole.withColumns({"tags": _list("tags"), "suggested": _list("suggested")})


def _rewritten(tags: Column, old: Column, new: Column | None) -> Column:
    if new is None:
        return F.filter(tags, lambda t: key(t) != old)
    return F.transform(tags, lambda t: F.when(key(t) == old, new).otherwise(t))


def renamed(questions: DataFrame, source: str, name: str | None, active: bool = False, usage: int | None = None) -> DataFrame:
    """A tag under another name in both lists; None deletes it. `changed` marks the questions it touched.

    The name is squeezed and cut to CHARS and must have two characters. active: the tag becomes an active one, for which
    it must be used by ACTIVE questions (`usage`); it moves from the suggested tags to the first MOST tags.
    """
    old, new = key(F.lit(source)), None
    if name is not None:
        name = " ".join(name.split())[:CHARS]
        if len(name) < 2:
            raise ValueError("a tag's name has two characters at least")
        new = F.lit(name)
    if active and (usage or 0) < ACTIVE:
        raise ValueError(f"an active tag is used by {ACTIVE} questions at least")
    has = F.exists(_all(), lambda t: key(t) == old)
    rows = questions.withColumns({"changed": has, "tags": _rewritten(_list("tags"), old, new), "suggested": _rewritten(_list("suggested"), old, new)})
    if active and name is not None:
        own = key(F.lit(name))
        held = F.exists("suggested", lambda t: key(t) == own)
        rows = rows.withColumn("tags", F.when(held, F.slice(F.array_distinct(F.concat("tags", F.array(new))), 1, MOST)).otherwise(F.col("tags")))
        rows = rows.withColumn("suggested", F.when(held, F.filter("suggested", lambda t: key(t) != own)).otherwise(F.col("suggested")))
    return rows


def merged(questions: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Several tags under the target's name, once each, MOST at most; no tag is suggested beside itself."""
    olds = F.array(*(key(F.lit(s)) for s in sources))
    one = lambda c: F.slice(F.array_distinct(F.transform(_list(c), lambda t: F.when(F.array_contains(olds, key(t)), F.lit(target)).otherwise(t))), 1, MOST)
    changed = F.exists(_all(), lambda t: F.array_contains(olds, key(t)))
    rows = questions.withColumns({"changed": changed, "tags": one("tags"), "suggested": one("suggested")})
    return rows.withColumn("suggested", F.array_except("suggested", "tags"))


def merge_targets(catalog: DataFrame) -> DataFrame:
    """(set_id, subject, source, target): the active tags that a tag of the catalog may be merged into, others of its set
    and subject. One row per pair: meant for one set's catalog at a time."""
    a = catalog.where("status <> 'merged'").select("set_id", "subject", F.col("key").alias("source"))
    return a.join(catalog.where("status = 'active'").select("set_id", "subject", F.col("key").alias("target")), ["set_id", "subject"]).where("source <> target")


def merged_catalog(catalog: DataFrame, source: str, target: str) -> DataFrame:
    """The catalog after a merge: the source is `merged` into the target and unused, the target active."""
    own, other = F.col("key") == key(F.lit(source)), F.col("key") == key(F.lit(target))
    status = F.when(own, "merged").when(other, "active").otherwise(F.col("status"))
    return catalog.withColumns({"status": status, "usage": F.when(own, 0).otherwise(F.col("usage")), "merged_into": F.when(own, F.lit(target)).otherwise("")})


def search(catalog: DataFrame, needle: str) -> DataFrame:
    """Catalog rows whose name or an alias holds the needle, whatever the case."""
    n = F.lower(F.lit(needle))
    return catalog.where(F.contains(F.lower("name"), n) | F.exists("aliases", lambda a: F.contains(F.lower(a), n)))


def totals(catalog: DataFrame) -> DataFrame:
    """Uses of each key over all sets, the most used first; the least name stands for it."""
    return catalog.groupBy("key").agg(F.sum("usage").alias("total"), F.min("name").alias("name"))

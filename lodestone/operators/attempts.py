"""Calls to models that may fail: each attempt is a row, what is still open is asked again in a later pass, and answers that
break their schema are repaired once and then made by rule.

A pass is one job over the open rows only, so a slow or failing row holds up no other, and what is done is kept in the
shared folder: a lost executor costs the pass it was in. The number of passes is bounded by the tries, not by the rows.
Keys must be unique and not null. Empty tables are never asked.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import schemas
from ..store import kept, shipped

ANSWER = "struct<status:int,retry_after:double,fatal:boolean,invalid:string,value:string>"
#: status codes: those that a plainer model may answer, those worth another try
PLAINER, AGAIN = (400, 404, 422), (429, 500, 502, 503, 504)


def asked(rows: DataFrame, call: Callable[[list[dict]], list], name: str, kind: str, batch: int = 20) -> DataFrame:
    """rows with what `call` returns for each, in batches; an exception, or a wrong number of answers, gives nulls.

    A batch alone is made into dicts; the rows themselves pass through as they are.
    """
    shipped(rows.sparkSession)

    def answered(some: list[dict]) -> list:
        try:
            found = call(some)
            return found if len(found) == len(some) else [None] * len(some)
        except Exception:
            return [None] * len(some)

    made = rows.sparkSession.createDataFrame([], f"`{name}` {kind}")
    type_ = made.toArrow().schema.field(0).type

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            answers = [pa.array(answered(part.slice(i, batch).to_pylist()), type_) for i in range(0, part.num_rows, batch)]
            yield part.append_column(name, pa.concat_arrays(answers) if answers else pa.array([], type_))

    return rows.mapInArrow(run, StructType([*rows.schema, *made.schema]))


def jitter(key: Column, attempt: Column, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on key, attempt and seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key, attempt), F.lit(1 << 30)) / float(1 << 30)


def judged(key: str, tries: int, base: float) -> dict[str, Column]:
    """What becomes of a row after an answer: state (open, done, failed, fatal), code, kind, the model of the next attempt,
    whether it fell back, and the wait before it."""
    a = F.col("answer")
    status, lost = a["status"], F.col("answer").isNull()
    good = ~lost & status.isNull() & a["invalid"].isNull() & a["value"].isNotNull()
    plainer = F.coalesce(status.isin(*PLAINER) & ~F.col("fell_back") & (F.col("model") != F.col("plain_model")), F.lit(False))
    fatal = F.coalesce(a["fatal"], F.lit(False))
    again = lost | F.coalesce(status.isin(*AGAIN), F.lit(False)) | (status.isNull() & a["invalid"].isNull() & a["value"].isNull())
    counted = F.col("attempt") - F.col("fell_back").cast("int") + 1
    state = F.when(good, "done").when(a["invalid"].isNotNull(), "failed").when(plainer, "open").when(fatal, "fatal").when(~again | (counted >= tries), "failed").otherwise("open")
    code = F.when(good, "").when(a["invalid"].isNotNull(), a["invalid"]).when(status == 429, "provider_rate_limited").when(again, "provider_timeout").otherwise("provider_fatal")
    wait = F.greatest(F.coalesce(a["retry_after"], F.lit(0.0)), F.lit(base) * F.pow(F.lit(2.0), F.col("attempt")) * (0.5 + jitter(F.col(key), F.col("attempt"))))
    return {
        "state": state, "code": code, "kind": F.when(good, "").when(a["invalid"].isNotNull(), "validation").otherwise("provider"),
        "next_model": F.when(plainer, F.col("plain_model")).otherwise(F.col("model")), "fell_back": F.col("fell_back") | plainer, "wait": F.when((state == "open") & ~plainer, wait).otherwise(F.lit(0.0)),
    }


def attempted(rows: DataFrame, key: str, call: Callable[[list[dict]], list[dict]], tries: int = 3, base: float = 1.0, batch: int = 20, pause: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """(results, log) of asking for each of rows (key, model, plain_model, ...), at most `tries` times besides one change to
    the plain model. call: answers as dicts of ANSWER's fields, for rows as dicts, in order.

    results: key, state (done, failed, fatal, stopped), code, kind, value, attempts, model, fell_back. log: a row for each
    attempt, with its code and the wait after it. One fatal answer stops all further passes; what is open then is `stopped`.
    """
    now = kept(rows.withColumns({"attempt": F.lit(0), "fell_back": F.lit(False), "code": F.lit(""), "kind": F.lit("")}))
    ended, log = [], []
    fields = [key, "state", "code", "kind", F.col("answer.value").alias("value"), (F.col("attempt") + 1).alias("attempts"), "model", "fell_back"]
    for _ in range(tries + 1):
        found = kept(asked(now.drop("code", "kind"), call, "answer", ANSWER, batch).withColumns(judged(key, tries, base)))
        ended.append(found.where("state <> 'open'").select(*fields))
        log.append(found.select(key, "attempt", "model", "state", "code", "wait"))
        told = found.agg(F.count_if(F.col("state") == "open").alias("n"), F.count_if(F.col("state") == "fatal").alias("fatal"), F.coalesce(F.max("wait"), F.lit(0.0)).alias("wait")).first()
        now = found.where("state = 'open'").withColumns({"model": F.col("next_model"), "attempt": F.col("attempt") + 1}).drop("answer", "state", "next_model", "wait")
        if not told["n"]:
            break
        if told["fatal"]:
            ended.append(now.select(key, F.lit("stopped").alias("state"), "code", "kind", F.lit(None).cast("string").alias("value"), F.col("attempt").alias("attempts"), "model", "fell_back"))
            break
        if told["wait"]:
            pause(told["wait"])
    return reduce(DataFrame.union, ended), reduce(DataFrame.union, log)


def packaged(rows: DataFrame, generate: Callable[[list[dict]], list[str]], repair: Callable[[list[dict]], list[str]], by_rule: Column, node: schemas.Node, kind: str, problems: Column | None = None, repairs: int = 1, batch: int = 20) -> DataFrame:
    """rows with `answer` (JSON), `value`, `origin` (model, repaired, rule), `round` and `fault`, the last one that there was.

    Answers of `generate` that break the schema, or have `problems` (an expression over `value`, null if there are none),
    go to `repair`, with their fault, at most `repairs` times; what is still faulty gets the answer made by rule, which is
    not checked. No row is lost, and none is asked again once it is good.
    """
    done, now = [], rows.withColumn("fault", F.lit(None).cast("string"))
    names = rows.columns
    for k in range(repairs + 1):
        found = schemas.checked(asked(now, repair if k else generate, "answer", "string", batch).withColumnRenamed("fault", "_before"), "answer", node, kind)
        if problems is not None:
            found = found.withColumn("fault", F.coalesce("fault", problems))
        found = kept(found)
        told = [F.lit("repaired" if k else "model").alias("origin"), F.lit(k).alias("round")]
        done.append(found.where("fault IS NULL").select(*names, "answer", "value", *told, F.col("_before").alias("fault")))
        now = found.where("fault IS NOT NULL").select(*names, "fault")
    done.append(now.select(*names, by_rule.alias("answer"), F.from_json(by_rule, kind).alias("value"), F.lit("rule").alias("origin"), F.lit(repairs + 1).alias("round"), "fault"))
    return reduce(DataFrame.union, done)


def rank_faults(found: DataFrame, asked_for: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, fault): what is wrong with a reranker's results (query, index, score) for queries (query, n) of n candidates.

    In this order: an index outside 0..n-1 or null, one twice, a score that is null, not finite or outside 0..1, and results
    missing; '' if nothing is. Results of queries that were not asked are left out.
    """
    each = found.join(asked_for, query).groupBy(query).agg(
        F.count_if(F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("n"))).alias("outside"), F.count("*").alias("results"), F.count_distinct("index").alias("places"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)).alias("scores"),
    )
    rows = asked_for.join(each, query, "left")
    told = F.when(F.col("outside") > 0, "index").when(F.col("results") > F.col("places"), "repeated").when(F.col("scores") > 0, "score").when(F.coalesce("results", F.lit(0)) < F.col("n"), "missing")
    return rows.select(query, F.coalesce(told, F.lit("")).alias("fault"))

"""Retrieval quality: metrics at one setting, a grid search over settings, baselines, gates, samples, latencies.

Judged candidates are rows (query_id, grade, chunk_id, cosine, rerank, relevant). `truths` (query_id, grade, n_truth)
lists every query, with the number of its relevant chunks, found or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import hybrid_score


#: vectors and queries that meet in one task
PART, BLOCK = 20_000, 2_000
#: cosines that a task holds at once
CELLS = 500_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, cosine (6 decimals): the k vectors of greatest cosine to each query, of equal ones the least ids.

    Queries (query_id, vector) meet all vectors (vec_id, vector) in blocks: each task holds BLOCK queries and PART vectors
    at most, in double precision, and CELLS of their cosines at a time, and gives k rows a query; a vector is no neighbour of the query of its id. Null vectors
    must be left out; zero vectors have a cosine of 0, as have those of another length.
    """
    import numpy as np
    import pandas as pd

    n, m = vectors.count(), queries.count()
    parts, blocks = max(8, n // PART + 1), m // BLOCK + 1
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def met(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size in {len(x) for x in q["vector"]}:
            mine, theirs = (t[t["vector"].map(len) == size] for t in (q, v))
            a, b = (np.stack(t["vector"].to_numpy()).astype(float) if len(t) else np.zeros((0, size)) for t in (mine, theirs))
            unit = lambda x: x / np.where((s := np.sqrt((x * x).sum(1, keepdims=True))) == 0, 1, s)
            own, ids, a, b = mine["query_id"].to_numpy(), theirs["vec_id"].to_numpy(), unit(a), unit(b).T
            step = max(1, CELLS // max(1, len(ids)))
            for start in range(0, len(own), step):
                cosine = np.round(a[start : start + step] @ b, 6)
                other = ids != own[start : start + step, None]
                score = np.where(other & ~np.isnan(cosine), cosine, -np.inf)
                least = np.partition(score, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else -np.inf
                i, j = np.nonzero(other & (score >= least))
                order = np.lexsort((ids[j], -score[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                found.append(pd.DataFrame({"query_id": own[start + i], "vec_id": ids[j], "cosine": cosine[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(met, "query_id long, vec_id long, cosine double")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("_r") <= k).drop("_r")


def outcomes(candidates: DataFrame, truths: DataFrame, accepted: Column, score: Column, by: tuple[str, ...] = (), k: int = 3) -> DataFrame:
    """Per query (and setting): n_pred and rank of the first hit among its first k accepted candidates."""
    keys = [*by, "query_id"]
    rows = candidates.where(accepted).withColumn("_score", score)
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_score"), "chunk_id"))).where(F.col("_rank") <= k)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_pred"), F.min(F.when(F.col("relevant"), F.col("_rank"))).alias("hit"))


def metrics(found: DataFrame, truths: DataFrame, settings: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """f1 and recall as means over grades, recall_at_3 and mrr_at_3 as means over queries, and the false-match rate.

    A query without truth has recall 1 if nothing was predicted for it. settings: the grid's rows (by), if any.
    """
    every = truths
    if settings is not None:  # each query under each setting, by an equi-join on the setting's number
        every = truths.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(settings.count() - 1)))).join(F.broadcast(settings), "setting")
    keys = [*by, "query_id"]
    rows = every.join(found, keys, "left").withColumns({"n_pred": F.coalesce("n_pred", F.lit(0)), "is_hit": F.col("hit").isNotNull()})
    truth = F.col("n_truth") > 0
    rows = rows.withColumns(
        {
            "tp": (truth & F.col("is_hit")).cast("int"),
            "fp": ((F.col("n_pred") > 0) & ~F.col("is_hit")).cast("int"),
            "fn": (truth & ~F.col("is_hit")).cast("int"),
            "recall": F.when(truth, F.col("is_hit").cast("double")).otherwise((F.col("n_pred") == 0).cast("double")),
            "rr": F.when(F.col("is_hit"), 1 / F.col("hit")).otherwise(0.0),
        }
    )
    grades = rows.groupBy(*by, "grade").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "recall", "rr")), F.count("*").alias("n"))
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    grades = grades.withColumn("f1", 2 * p * r / F.greatest(F.lit(1e-12), p + r)).withColumn("mean_recall", F.col("recall") / F.col("n"))
    one = (lambda x: F.round(x, 6))
    fmr = F.sum("fp") / F.greatest(F.lit(1), F.sum("fp") + F.sum("tp"))
    wanted = [one(F.avg("f1")).alias("f1"), one(F.avg("mean_recall")).alias("macro_recall"), one(F.sum("recall") / F.sum("n")).alias("recall_at_3"), one(F.sum("rr") / F.sum("n")).alias("mrr_at_3"), one(fmr).alias("false_match_rate"), F.sum("n").alias("n_queries")]
    return grades.groupBy(*by).agg(*wanted) if by else grades.agg(*wanted)


def grid_search(candidates: DataFrame, truths: DataFrame, alphas: list[float], thresholds: list[float], baseline: float, least: int = 30) -> DataFrame:
    """The setting of best (f1, recall_at_3, mrr_at_3, -false_match_rate) whose false-match rate is not above the baseline.

    The earliest setting wins ties. `enabled` is false where a grade has fewer than `least` queries. The grid is a
    constant number of rows; each candidate meets those settings alone that accept it, and one aggregation does the rest.
    """
    spark = candidates.sparkSession
    settings = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate((a, t) for a in alphas for t in thresholds)], "setting int, alpha double, threshold double")
    # a candidate is repeated for every alpha, and then for those thresholds alone that it reaches
    rows = candidates.select("*", F.posexplode(F.array(*map(F.lit, alphas))).alias("_a", "alpha")).withColumn("hybrid", F.round(hybrid_score(F.col("cosine"), F.col("rerank"), F.col("alpha")), 9))
    reached = F.filter(F.sequence(F.lit(0), F.lit(len(thresholds) - 1)), lambda i: F.element_at(F.array(*map(F.lit, thresholds)), i + 1) <= F.col("hybrid"))
    rows = rows.withColumn("_t", F.explode(reached)).withColumns({"setting": (F.col("_a") * len(thresholds) + F.col("_t")).cast("int"), "threshold": F.element_at(F.array(*map(F.lit, thresholds)), F.col("_t") + 1)})
    by = ("setting", "alpha", "threshold")
    found = outcomes(rows, truths, F.lit(True), F.col("hybrid"), by)
    scored = metrics(found, truths, settings, by)
    order = F.struct("f1", "recall_at_3", "mrr_at_3", (-F.col("false_match_rate")).alias("v"), (-F.col("setting")).alias("i"))
    best = scored.where(F.col("false_match_rate") <= F.lit(baseline) + 1e-12).agg(F.max_by(F.struct("alpha", "threshold", "f1", "recall_at_3", "mrr_at_3", "false_match_rate"), order).alias("x")).select("x.*")
    enough = truths.groupBy("grade").count().agg((F.min("count") >= least).alias("e")).scalar()
    return best.withColumn("enabled", enough)


def quality_gate(baseline: DataFrame, candidate: DataFrame, gain: float = 0.03) -> DataFrame:
    """One row: whether the candidate's metrics are no worse in false matches and better in recall or mrr."""
    b, c = (d.agg(F.first(F.struct(*d.columns))).scalar() for d in (baseline, candidate))
    one = baseline.sparkSession.range(1).select(b.alias("b"), c.alias("c"))
    dr, dm = F.round(F.col("c.recall_at_3") - F.col("b.recall_at_3"), 6), F.round(F.col("c.mrr_at_3") - F.col("b.mrr_at_3"), 6)
    passed = (F.col("c.false_match_rate") <= F.col("b.false_match_rate")) & (((dr >= gain) & (dm >= 0)) | ((dm >= gain) & (dr >= 0)))
    return one.select(dr.alias("delta_recall"), dm.alias("delta_mrr"), passed.alias("passed"))


def stratified(rows: DataFrame, grade: str, stratum: list[str], id_: str, most: int = 80) -> DataFrame:
    """Round-robin over strata, `most` rows of each grade: first every stratum's first row, then every second, ..."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(grade, *stratum).orderBy(id_))).where(F.col("turn") <= most)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(grade).orderBy("turn", *stratum, id_))).where(F.col("place") <= most)


def nearest_rank(value: str, by: list[str], shares: dict[str, float], rows: DataFrame) -> DataFrame:
    """Exact percentiles, sorted[round((n - 1) * share)] with ties to even, of each group; no list of a group is built."""
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *(F.max(F.when(F.col("_i") == F.rint((F.col("_n") - 1) * F.lit(p)), F.col(value))).alias(n) for n, p in shares.items()))

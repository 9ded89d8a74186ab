"""Term index, BM25 in two variants, and evidence retrieval: candidates, cosine, books, fallbacks, reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scoring import cosine, hybrid_score, tiers
from ..functions.text import STOP, query_terms, tokens
from ..store import kept

#: (query, term) rows that go to every task; more queries are searched for in several passes
TERMS = 200_000
#: scores, sums and rows that a task holds at once
CELLS, SUMS, ROWS = 250_000, 1_000_000, 100_000
#: scores are compared by 6 decimals, so what is nearer than this may be equal
MARGIN = 2e-6


@dataclass(frozen=True)
class Variant:
    """A BM25 flavour. floor: least idf; epsilon: share of the mean idf that replaces a negative one."""

    k1: float
    b: float = 0.75
    floor: float | None = None
    epsilon: float | None = None
    distinct: bool = True


FTS = Variant(1.2, floor=1e-6)
OKAPI = Variant(1.5, epsilon=0.25, distinct=False)


@dataclass(frozen=True)
class Index:
    """Chunks with their tokens, made where a chunk is read; nothing is stored."""

    chunks: DataFrame
    carried: tuple[str, ...]


def indexed(chunks: DataFrame, carry: tuple[str, ...] = ()) -> Index:
    """The index of chunks (chunk_id, chunk_text and columns to carry)."""
    return Index(chunks.select("chunk_id", *carry, tokens(F.col("chunk_text")).alias("tokens")), carry)


def asked(queries: DataFrame, text: str = "text", stop: Sequence[str] = STOP, variant: Variant = FTS) -> DataFrame:
    """query_id, term, times: the terms each query asks for; stop words count in the variant that takes no repeats."""
    found = query_terms(F.col(text), stop) if variant.distinct else tokens(F.col(text))
    return queries.select("query_id", F.explode(found).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def weighted(index: Index, terms: DataFrame, variant: Variant = FTS) -> tuple[pa.Table, float]:
    """The asked terms (query_id, term, weight), few, and the mean length of chunks.

    Statistics come from all chunks, whatever scope a search has: one pass counts the chunks of each term, and under the
    empty term all chunks. Okapi's mean idf needs the whole vocabulary, whose counts are kept for that.
    """
    words = index.chunks.select(F.size("tokens").alias("length"), F.explode_outer(F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")))).alias("term"))
    mine = terms.select("term").unionByName(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    if variant.epsilon is None:
        words = words.join(F.broadcast(mine), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    usual = 0.0
    if variant.epsilon is not None:
        counts = kept(counts)
        n = counts.where("term = ''").select("df").first()
        usual = counts.where("term <> ''").agg(F.avg(F.log((n["df"] - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] if n else None
        counts = counts.join(F.broadcast(mine), "term", "left_semi")
    known = {r["term"]: (r["df"], r["mean"]) for r in counts.collect()}
    n, mean = known.get("", (0, None))

    def idf(term: str) -> float:
        x = math.log((n - known[term][0] + 0.5) / (known[term][0] + 0.5))
        if variant.floor is not None and x <= 0:
            return variant.floor
        return (usual or 0.0) * variant.epsilon if variant.epsilon is not None and x < 0 else x

    found = terms.toArrow()
    found = found.filter(pc.is_in(found["term"], pa.array([t for t in known if t], pa.string())))
    weights = [idf(t) * times for t, times in zip(found["term"].to_pylist(), found["times"].to_pylist(), strict=True)]
    return found.select(["query_id", "term"]).append_column("weight", pa.array(weights, pa.float64())), max(mean or 0.0, 1e-9)


def searched(index: Index, terms: DataFrame, k: int, variant: Variant, by: str | None) -> DataFrame:
    """query_id, chunk_id, what the index carries, and score (6 decimals): each task's k best of each query (in each `by`).

    The terms of all queries meet the chunks where these are read. A task scores a block of chunks at a time and keeps
    the k best rows found so far, of equal scores those of the least chunk_id; a hit that k better ones precede goes
    nowhere. What a task holds is bounded whatever it reads: rows beyond ROWS are handed on, and their scores remembered.
    """
    weights, mean = weighted(index, terms, variant)
    queries, words = weights["query_id"].combine_chunks().dictionary_encode(), weights["term"].combine_chunks().dictionary_encode()
    ids, vocabulary = queries.dictionary, words.dictionary
    order = np.lexsort((queries.indices.to_numpy(), words.indices.to_numpy()))
    query, weight = queries.indices.to_numpy()[order].astype(np.int64), weights["weight"].to_numpy()[order]
    many = np.bincount(words.indices.to_numpy(), minlength=len(vocabulary))
    first, carried, k1, b = np.cumsum(many) - many, ["chunk_id", *index.carried], variant.k1, variant.b

    def scores(tokens_: pa.Array) -> np.ndarray:
        """A row for each query, a column for each chunk; -inf where a chunk has none of the query's terms."""
        m, lengths = len(tokens_), pc.fill_null(pc.list_value_length(tokens_), 0).to_numpy()
        at = pc.index_in(tokens_.flatten(), value_set=vocabulary)
        cell, tf = np.unique(np.repeat(np.arange(m), lengths)[at.is_valid().to_numpy(zero_copy_only=False)] * len(vocabulary) + at.drop_null().to_numpy(), return_counts=True)
        row, term = np.divmod(cell, len(vocabulary))
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean))
        total, hit = np.zeros(len(ids) * m), np.zeros(len(ids) * m, bool)
        piece = np.cumsum(many[term]) // SUMS
        for p in np.unique(piece):
            some = slice(*np.searchsorted(piece, [p, p + 1]))
            n = many[term[some]]
            each = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(each)) - (np.cumsum(n) - n)[each] + first[term[some]][each]
            cells = query[place] * m + row[some][each]
            total += np.bincount(cells, weight[place] * share[some][each], len(total))
            hit[cells] = True
        return np.where(hit, total, -np.inf).reshape(len(ids), m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, groups = max(1, CELLS // max(1, len(ids))), {}
        least = np.empty((0, len(ids)))  # of each group and query, what a score must reach
        rows, known = None, np.empty((3, 0))  # the best rows so far; their query, group and score

        def told() -> list[pa.RecordBatch]:
            columns = [ids.take(pa.array(known[0].astype(np.int64))), *(rows[c] for c in carried), pa.array(known[2])]
            return pa.table(columns, names=["query_id", *carried, "score"]).combine_chunks().to_batches()

        for batch in batches:
            for start in range(0, batch.num_rows if len(ids) else 0, block):
                part = batch.slice(start, block)
                score, code = scores(part.column("tokens")), np.zeros(part.num_rows, int)
                if by:
                    own = part.column(by).dictionary_encode(null_encoding="encode")
                    code = np.array([groups.setdefault(v, len(groups)) for v in own.dictionary.to_pylist()])[own.indices.to_numpy()]
                least = np.vstack([least, np.full((max(1, len(groups)) - len(least), len(ids)), -np.inf)])
                found = [known]
                for g in np.unique(code):
                    mine = np.flatnonzero(code == g)
                    sub = score[:, mine]
                    if len(mine) > k:
                        least[g] = np.maximum(least[g], np.partition(sub, len(mine) - k, axis=1)[:, len(mine) - k] - MARGIN)
                    q, c = np.nonzero((sub >= least[g][:, None]) & (sub > -np.inf))
                    exact = sub[q, c]
                    found.append(np.stack([q, np.full(len(q), g), np.copysign(np.floor(np.abs(exact) * 1e6 + 0.5) / 1e6, exact)]))
                    found.append(mine[c])
                n = known.shape[1]
                at = np.concatenate([np.arange(n), *(x + n for x in found[2::2])])
                if len(at) == n:
                    continue
                known = np.concatenate([found[0], *found[1::2]], axis=1)
                both = pa.Table.from_batches([part]).select(carried)
                both = both if rows is None else pa.concat_tables([rows, both])
                place = pc.rank(both["chunk_id"].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()[at]
                order = np.lexsort((place, -known[2], known[0], known[1]))
                known, at = known[:, order], at[order]
                new = np.flatnonzero(np.r_[True, (np.diff(known[0]) != 0) | (np.diff(known[1]) != 0)])
                size = np.diff(np.r_[new, len(at)])
                full = new[size >= k] + k - 1
                least[known[1, full].astype(int), known[0, full].astype(int)] = np.maximum(least[known[1, full].astype(int), known[0, full].astype(int)], known[2, full] - MARGIN)
                stay = np.arange(len(at)) - np.repeat(new, size) < k
                known, rows = known[:, stay], both.take(pa.array(at[stay]))
                if known.shape[1] > ROWS:
                    yield from told()
                    rows, known = None, known[:, :0]
        if known.shape[1]:
            yield from told()

    kinds = index.chunks.select(*carried).schema
    out = StructType([terms.schema["query_id"], *kinds, StructField("score", DoubleType())])
    return index.chunks.select(*carried, "tokens").mapInArrow(run, out)


def best(index: Index, terms: DataFrame, k: int, variant: Variant = FTS, by: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank and what the index carries: the k best chunks of each query (in each `by`).

    Where there are more than TERMS asked terms, the queries are dealt into groups, each searched for in a pass of its own.
    """
    group, passes = ["query_id", *([by] if by else [])], terms.count() // TERMS + 1
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    found = [kept(top(searched(index, terms.where(dealt == i) if passes > 1 else terms, k, variant, by), k, group, [F.desc("score"), F.col("chunk_id")])) for i in range(passes)]
    return reduce(DataFrame.unionByName, found)


def scoped(index: Index, terms: DataFrame, scope: DataFrame, k: int, on: str, variant: Variant = FTS) -> DataFrame:
    """best() for each (query_id, role) of scope (query_id, role, and the carried column `on`): a search of its own in each
    role's part of the index, with the statistics of all of it."""
    hits = best(index, terms, k, variant, on).drop("rank").join(scope, ["query_id", on])
    return top(hits, k, ["query_id", "role"], [F.desc("score"), F.col("chunk_id")])


def top(rows: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def filled(found: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k hits get chunks of score 0, of the smallest ids, as a scan over all scores would give."""
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k).agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    have = queries.select("query_id").join(found.groupBy("query_id").agg(F.collect_list("chunk_id").alias("have")), "query_id", "left")
    lacking = have.where(F.coalesce(F.size("have"), F.lit(0)) < k).select("query_id", F.explode(F.array_except(first.scalar(), F.coalesce("have", F.array().cast("array<string>")))).alias("chunk_id"), F.lit(0.0).alias("score"))
    return found.select("query_id", "chunk_id", "score").unionByName(lacking)


def with_cosine(candidates: DataFrame, vectors: DataFrame, of_query: DataFrame) -> DataFrame:
    """Candidates with `cosine`, 6 decimals; those without a vector go. vectors: vector_id, vector; of_query: query_id, vector."""
    rows = candidates.join(vectors.where("vector IS NOT NULL"), "vector_id").join(of_query.select("query_id", F.col("vector").alias("asked")), "query_id")
    return rows.withColumn("cosine", F.round(cosine(F.col("vector"), F.col("asked")), 6)).drop("vector", "asked")


def diverse(candidates: DataFrame, books: int, threshold: float, top_k: int) -> DataFrame:
    """Evidence from several books: the best of each book above the floor, then the best of the rest above it.

    Where nothing reaches the floor the single best stays. One book: the best top_k, no floor.
    """
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id"))
    if books <= 1:
        return candidates.withColumn("rank", best).where(F.col("rank") <= top_k)
    floor, most = tiers(threshold)[2], max(top_k, min(4, books))
    of_book = F.row_number().over(Window.partitionBy("query_id", "book").orderBy(F.desc("cosine"), "chunk_id"))
    rows = candidates.withColumn("_book", of_book).withColumn("_best", best).withColumn("_first", (F.col("_book") == 1) & (F.col("cosine") >= floor))
    rows = rows.where((F.col("cosine") >= floor) | (F.col("_best") == 1))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_first"), F.desc("cosine"), "chunk_id")))
    # a best row below the floor counts only where it is alone
    return rows.where((F.col("rank") <= most) & ((F.col("cosine") >= floor) | (F.col("rank") == 1))).drop("_book", "_best", "_first")


def merged(rows: DataFrame, score: str = "score") -> DataFrame:
    """The best of each query's hits of one chunk over several sub-queries; with a column `clue`, the clues it supports."""
    more = [F.sort_array(F.collect_set("clue")).alias("clues")] if "clue" in rows.columns else []
    return rows.groupBy("query_id", "chunk_id").agg(F.max(score).alias(score), F.count("*").alias("n_queries"), *more)


def aliased(subject: Column, aliases: dict[str, str], hops: int = 8) -> Column:
    """The canonical name at the end of a chain of aliases; cycles end after `hops`."""
    fold = lambda x: " ".join(x.split()).lower()
    closed = {}
    for name in aliases:
        at, seen = name, {fold(name)}
        for _ in range(hops):
            nxt = next((v for k, v in aliases.items() if fold(k) == fold(at)), None)
            if nxt is None or fold(nxt) in seen:
                break
            at = nxt
            seen.add(fold(at))
        closed[fold(name)] = at
    table = F.create_map(*(F.lit(x) for kv in closed.items() for x in kv)) if closed else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(table, F.lower(F.trim(F.regexp_replace(subject, "[ \t\n]+", " ")))), subject)


def fallback(primary: DataFrame, secondary: DataFrame, threshold: float) -> DataFrame:
    """Per query the primary match if it reaches the threshold, else the secondary one if it reaches the stricter limit,
    else whichever scores higher, kept for audit. Both: query_id, chunk_id, cosine of the best match."""
    strict = max(0.70, threshold + 0.08)
    both = primary.select("query_id", F.struct(F.col("cosine").alias("c"), F.col("chunk_id").alias("id")).alias("p")).join(secondary.select("query_id", F.struct(F.col("cosine").alias("c"), F.col("chunk_id").alias("id")).alias("s")), "query_id", "full")
    p, s = F.col("p.c"), F.col("s.c")
    scope = F.when(p >= threshold, "primary").when(s >= strict, "secondary").when(s.isNull() | (p >= s), "primary").otherwise("secondary")
    both = both.withColumn("scope", scope).withColumn("used", F.when(F.col("scope") == "primary", F.col("p")).otherwise(F.col("s")))
    matched = F.when(F.col("scope") == "primary", p >= threshold).otherwise(s >= strict)
    return both.select("query_id", "scope", F.col("used.id").alias("chunk_id"), F.col("used.c").alias("cosine"), F.coalesce(matched, F.lit(False)).alias("is_matched"))


def reranked(candidates: DataFrame, alpha: float | None, top_k: int, most: int = 20) -> DataFrame:
    """Final evidence from candidates with cosine and rerank: best of each chunk, the top `most`, one of each book.

    alpha: weight of cosine in the calibrated score; None: order by rerank alone and keep cosine as the score.
    """
    best = candidates.groupBy("query_id", "chunk_id", "book").agg(F.max("cosine").alias("cosine"), F.max("rerank").alias("rerank"))
    best = top(best, most, ["query_id"], [F.desc("cosine"), F.col("chunk_id")], "_pool")
    score = F.round(hybrid_score(F.col("cosine"), F.col("rerank"), alpha), 6) if alpha is not None else F.col("cosine")
    best = best.withColumn("final", score).withColumn("_order", F.col("final") if alpha is not None else F.col("rerank"))
    best = top(best, 1, ["query_id", "book"], [F.desc("_order"), F.col("chunk_id")], "_one")
    return top(best, top_k, ["query_id"], [F.desc("_order"), F.col("chunk_id")]).drop("_pool", "_one", "_order")


def printed_page(rows: DataFrame, page_map: DataFrame, offset: Column) -> DataFrame:
    """page_map (library_id, pdf_page, printed_page): a calibrated library maps or has none, another subtracts its offset."""
    known = rows.join(page_map, ["library_id", "pdf_page"], "left")
    page = F.when(F.col("calibrated"), F.coalesce("printed_page", F.lit(0))).otherwise(F.col("pdf_page") - offset)
    return known.withColumn("printed_page", F.when(page > 0, page))

"""Named queries over the driver's tables, each an application of operators of this package, and their SQL oracles.

documents are textbook files (source: book, lang: subject), their windows are chunks; benchmark rows are questions;
embeddings are vectors by doc_id and item_id; labels are reviewed flags; orders are status rows; events are a job log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import chunking, evaluation, evidence, retrieval, routing
from ..sources.readers import tables
from ..store import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return note


def long(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


# --- chunks and retrieval ---------------------------------------------------------------------------------------------

WINDOWS = r"""
raw AS (SELECT doc_id, source, lang, i, regexp_replace(regexp_replace(substr(text, CAST(i * 450 + 1 AS INT), 500), '^[ \t\n\f\r]+', ''), '[ \t\n\f\r]+$', '') AS chunk_text
  FROM (SELECT doc_id, source, lang, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 500) / 450.0) AS INT)))) AS i FROM documents WHERE text IS NOT NULL)),
chunks AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, chunk_text,
  lpad(CAST(doc_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS VARCHAR), 6, '0') AS chunk_id FROM raw WHERE chunk_text <> '')"""

STOPPED = ", ".join(f"'{w}'" for w in text.STOP)
TERMS = r"""
words AS (SELECT item_id AS query_id, unnest(t) AS term, unnest(generate_series(1, len(t))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[一-鿿]|[a-z]+|\p{Nd}+(?:\.\p{Nd}+)?') AS t FROM benchmark)),
firsts AS (SELECT query_id, term, min(pos) AS pos, count(*) AS times FROM words GROUP BY ALL),
terms AS (SELECT query_id, term, 1 AS times FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM firsts WHERE term NOT IN (STOPPED)) WHERE r <= 16)""".replace("STOPPED", STOPPED)

INDEX = r"""
toks AS (SELECT chunk_id, regexp_extract_all(lower(chunk_text), '[一-鿿]|[a-z]+|\p{Nd}+(?:\.\p{Nd}+)?') AS t FROM chunks),
size AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
flat AS (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM toks),
tf AS (SELECT term, chunk_id, length, count(*) AS tf FROM flat GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""

FTS_HITS = r"""
hits AS (SELECT query_id, chunk_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))), 6) AS score
  FROM terms JOIN tf USING (term) JOIN df USING (term) CROSS JOIN size GROUP BY query_id, chunk_id)"""

CANDIDATES = "WITH " + ",".join([WINDOWS, TERMS, INDEX, FTS_HITS]) + """,
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits) WHERE r <= 20),
cand AS (SELECT t.query_id, t.chunk_id, t.score, c.doc_id, c.source AS book, c.lang, coalesce(round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6), 0) AS cosine
  FROM top20 t JOIN chunks c USING (chunk_id) JOIN embeddings v ON v.vec_id = c.doc_id JOIN embeddings q ON q.vec_id = t.query_id WHERE v.embedding IS NOT NULL)"""


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = tables(spark, sf, "documents")
    rows = chunking.windows(docs.select("doc_id", "source", "lang", "text"))
    return rows.withColumn("chunk_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("chunk_index").cast("string"), 6, "0")))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "benchmark")[0].select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    (e,) = tables(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def candidates(spark: SparkSession, sf: str, k: int = 20, carry: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, doc_id, book, lang, cosine of the questions' BM25 candidates that have a vector."""
    index = retrieval.indexed(chunked(spark, sf).withColumnRenamed("source", "book"), ("doc_id", "book", "lang", *carry))
    rows = retrieval.best(index, retrieval.asked(asked(spark, sf)), k, by=by).drop("rank")
    return retrieval.with_cosine(rows.withColumnRenamed("doc_id", "vector_id"), *vectors(spark, sf)).withColumnRenamed("vector_id", "doc_id")


@query("WITH " + WINDOWS + " SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(length(chunk_text) AS BIGINT) AS n_chars, md5(chunk_text) AS chunk_md5 FROM chunks")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(spark, sf).select("doc_id", long("chunk_index"), long(F.char_length("chunk_text"), "n_chars"), F.md5("chunk_text").alias("chunk_md5"))


@query(r"""WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^\|.*\|$') THEN 'table' WHEN regexp_matches(line, '^\$\$|^\\\[') THEN 'formula' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM l),
m AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN regexp_replace(line, '^#+ ', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> kind OR kind IN ('formula', 'heading') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM m)
SELECT doc_id, CAST(block AS BIGINT) AS block, kind, title, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5 FROM n WHERE kind NOT IN ('blank', 'heading') GROUP BY doc_id, block, kind, title""")
def structural_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.blocks(tables(spark, sf, "documents")[0]).select("doc_id", long("block"), "kind", "title", F.md5("text").alias("text_md5"))


@query("WITH " + ",".join([WINDOWS, TERMS, INDEX, FTS_HITS]) + " SELECT query_id, chunk_id, score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits) WHERE r <= 20")
def bm25_fts5_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.best(retrieval.indexed(chunked(spark, sf)), retrieval.asked(asked(spark, sf)), 20).select("query_id", "chunk_id", "score", long("rank"))


@query("WITH " + ",".join([WINDOWS, TERMS, INDEX]) + """,
mean_idf AS (SELECT avg(ln((n - df + 0.5) / (df + 0.5))) AS m FROM df CROSS JOIN size),
hits AS (SELECT query_id, chunk_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN m * 0.25 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) * times), 6) AS score
  FROM firsts JOIN tf USING (term) JOIN df USING (term) CROSS JOIN size CROSS JOIN mean_idf GROUP BY query_id, chunk_id),
pool AS (SELECT query_id, chunk_id, score FROM hits UNION ALL SELECT q.item_id, c.chunk_id, 0.0 FROM benchmark q CROSS JOIN (SELECT chunk_id FROM chunks ORDER BY chunk_id LIMIT 40) c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.item_id AND h.chunk_id = c.chunk_id) AND (SELECT count(*) FROM hits h WHERE h.query_id = q.item_id) < 20)
SELECT query_id, chunk_id, score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM pool) WHERE r <= 20""")
def bm25_okapi_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.indexed(chunked(spark, sf))
    best = retrieval.best(index, retrieval.asked(asked(spark, sf), variant=retrieval.OKAPI), 20, retrieval.OKAPI).drop("rank")
    whole = retrieval.filled(best, asked(spark, sf), index.chunks, 20)
    return retrieval.top(whole, 20, ["query_id"], [F.desc("score"), F.col("chunk_id")]).select("query_id", "chunk_id", "score", long("rank"))


@query(CANDIDATES + " SELECT query_id, chunk_id, cosine, CAST(rank AS BIGINT) AS rank, cosine >= 0.5 AS is_matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM cand) WHERE rank <= 3")
def cosine_rerank(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.diverse(candidates(spark, sf), 1, 0.5, 3)
    return best.select("query_id", "chunk_id", "cosine", long("rank"), (F.col("cosine") >= 0.5).alias("is_matched"))


def surely(best: DataFrame) -> DataFrame:
    """With the confidence of each query's match, from its few best rows, in the partitions they are in."""
    scores = F.collect_list("cosine").over(Window.partitionBy("query_id"))
    return best.withColumn("_scores", scores).withColumn("confidence", scoring.match_confidence(F.col("_scores"), 0.5)).drop("_scores")


HYBRID = CANDIDATES + """,
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM cand),
conf AS (SELECT query_id, max(cosine) AS top_score, CASE WHEN max(cosine) < 0.5 THEN 'low' WHEN max(cosine) >= 0.70 OR count_if(cosine >= 0.65) >= 2 THEN 'strong' ELSE 'standard' END AS confidence FROM best WHERE rank <= 3 GROUP BY query_id)"""


@query(HYBRID + " SELECT query_id, chunk_id, score AS bm25, cosine, CAST(rank AS BIGINT) AS rank, confidence FROM best JOIN conf USING (query_id) WHERE rank <= 3")
def hybrid_retrieve_top3(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: windows, BM25 candidates over all of them, cosine, the best three, and how sure the match is."""
    return surely(retrieval.diverse(candidates(spark, sf), 1, 0.5, 3)).select("query_id", "chunk_id", F.col("score").alias("bm25"), "cosine", long("rank"), "confidence")


@query(CANDIDATES.replace("PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits) WHERE r <= 20", "PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS r FROM hits JOIN (SELECT chunk_id, source FROM chunks) USING (chunk_id)) WHERE r <= 12") + """,
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY cosine DESC, chunk_id) AS in_book, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS best FROM cand),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN in_book = 1 AND cosine >= 0.55 THEN 0 ELSE 1 END, cosine DESC, chunk_id) AS rank FROM b WHERE cosine >= 0.55 OR best = 1)
SELECT query_id, book, chunk_id, cosine, CAST(rank AS BIGINT) AS rank FROM s WHERE rank <= 4 AND (cosine >= 0.55 OR rank = 1)""")
def per_book_diversity(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.diverse(candidates(spark, sf, 12, by="book"), 20, 0.5, 3)
    return best.select("query_id", "book", "chunk_id", "cosine", long("rank"))


@query("WITH " + ",".join([WINDOWS, TERMS, INDEX, FTS_HITS]) + """,
q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS subject FROM benchmark),
scoped AS (SELECT h.*, c.doc_id, CASE WHEN c.lang = q.subject THEN 'primary' ELSE 'secondary' END AS role FROM hits h JOIN chunks c USING (chunk_id) JOIN q USING (query_id) WHERE c.lang IS NOT NULL),
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, chunk_id) AS r FROM scoped) WHERE r <= 20),
cand AS (SELECT t.query_id, t.role, t.chunk_id, coalesce(round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])), 6), 0) AS cosine FROM top20 t JOIN embeddings v ON v.vec_id = t.doc_id JOIN embeddings w ON w.vec_id = t.query_id WHERE v.embedding IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY cosine DESC, chunk_id) AS n FROM cand) WHERE n = 1),
pr AS (SELECT query_id, cosine AS c, chunk_id AS id FROM one WHERE role = 'primary'),
sr AS (SELECT query_id, cosine AS c, chunk_id AS id FROM one WHERE role = 'secondary'),
j AS (SELECT coalesce(pr.query_id, sr.query_id) AS query_id, pr.c AS pc, pr.id AS pid, sr.c AS sc, sr.id AS sid FROM pr FULL JOIN sr ON pr.query_id = sr.query_id),
k AS (SELECT *, CASE WHEN pc >= 0.5 THEN 'primary' WHEN sc >= 0.7 THEN 'secondary' WHEN sc IS NULL OR pc >= sc THEN 'primary' ELSE 'secondary' END AS scope FROM j)
SELECT query_id, scope, CASE scope WHEN 'primary' THEN pid ELSE sid END AS chunk_id, CASE scope WHEN 'primary' THEN pc ELSE sc END AS cosine, coalesce(CASE scope WHEN 'primary' THEN pc >= 0.5 ELSE sc >= 0.7 END, false) AS is_matched FROM k""")
def subject_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's subject is searched, and so are all others, beside it: two searches, of which one is taken."""
    names = F.element_at(F.array(F.lit("English "), F.lit("  francais"), F.lit("Deutsch")), (F.col("query_id") % 3 + 1).cast("int"))
    aliases = {"english": "Anglais", "anglais": "en", "Francais": "fr", "deutsch": "German", "german": "de"}
    chunks = chunked(spark, sf)
    langs = tables(spark, sf, "documents")[0].where("lang IS NOT NULL").select(F.col("lang").alias("library_id"), F.col("lang").alias("subject")).distinct()
    scope = routing.routed(asked(spark, sf).select("query_id", names.alias("subject")), langs, aliases, chosen=True).withColumnRenamed("library_id", "lang")
    index = retrieval.indexed(chunks, ("doc_id", "lang"))
    rows = retrieval.scoped(index, retrieval.asked(asked(spark, sf)), scope, 20, "lang").drop("rank").withColumnRenamed("doc_id", "vector_id")
    rows = retrieval.with_cosine(rows, *vectors(spark, sf))
    one = lambda role: retrieval.top(rows.where(F.col("role") == role), 1, ["query_id"], [F.desc("cosine"), F.col("chunk_id")]).select("query_id", "chunk_id", "cosine")
    return retrieval.fallback(one("primary"), one("secondary"), 0.5)


@query("WITH " + WINDOWS + r""",
halves AS (SELECT item_id, regexp_extract_all(lower(text), '[一-鿿]|[a-z]+|\p{Nd}+(?:\.\p{Nd}+)?') AS t FROM benchmark),
sub AS (SELECT item_id * 2 AS sub_id, list_slice(t, 1, len(t) // 2) AS t FROM halves UNION ALL SELECT item_id * 2 + 1, list_slice(t, len(t) // 2 + 1, len(t)) FROM halves),
words AS (SELECT sub_id AS query_id, unnest(t) AS term, unnest(generate_series(1, len(t))) AS pos FROM sub),
terms AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM (SELECT query_id, term, min(pos) AS pos FROM words WHERE term NOT IN (STOPPED) GROUP BY ALL)) WHERE r <= 16),""".replace("STOPPED", STOPPED) + INDEX + "," + FTS_HITS + """,
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits) WHERE r <= 20)
SELECT query_id // 2 AS query_id, chunk_id, max(score) AS score, count(*) AS n_queries FROM top20 GROUP BY ALL""")
def multi_query_merge(spark: SparkSession, sf: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    half = F.floor(F.size(t) / 2).cast("int")
    parts = F.array(F.array_join(F.slice(t, F.lit(1), half), " "), F.array_join(F.slice(t, half + 1, F.size(t)), " "))
    subs = asked(spark, sf).select("query_id", F.posexplode(parts).alias("at", "text")).select((F.col("query_id") * 2 + F.col("at")).alias("query_id"), "text")
    hits = retrieval.best(retrieval.indexed(chunked(spark, sf)), retrieval.asked(subs), 20)
    return retrieval.merged(hits.withColumn("query_id", F.floor(F.col("query_id") / 2)))


STUB = "round((doc_id * 37 + query_id * 11) % 101 / 100.0, 6)"


def stub_rerank() -> Column:
    """A deterministic stand-in for a reranking model."""
    return F.round((F.col("doc_id") * 37 + F.col("query_id") * 11) % 101 / 100.0, 6)


@query(CANDIDATES + f""",
r0 AS (SELECT query_id, chunk_id, book, cosine, round(0.25 * (cosine + 1) / 2 + 0.75 * {STUB}, 6) AS final FROM cand),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY final DESC, chunk_id) AS one FROM r0)
SELECT query_id, chunk_id, book, final, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM r1 WHERE one = 1) WHERE rank <= 3""")
def rerank_finalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).withColumn("rerank", stub_rerank())
    return retrieval.reranked(rows, 0.25, 3).select("query_id", "chunk_id", "book", "final", long("rank"))


@query(HYBRID + r""",
one AS (SELECT b.query_id, b.cosine, c.chunk_text FROM best b JOIN chunks c USING (chunk_id) WHERE rank = 1),
ts AS (SELECT query_id, count(*) AS n_terms FROM terms WHERE length(term) BETWEEN 3 AND 21 GROUP BY query_id),
cov AS (SELECT o.query_id, count(*) AS covered FROM one o JOIN terms t USING (query_id) WHERE length(term) BETWEEN 3 AND 21 AND contains(lower(chunk_text), term) GROUP BY o.query_id)
SELECT o.query_id, confidence, coalesce(covered, 0) AS covered, CASE WHEN o.cosine < 0.5 THEN 'C' WHEN confidence = 'strong' AND coalesce(covered, 0) >= least(2, greatest(1, coalesce(n_terms, 0))) THEN 'A' ELSE 'B' END AS grade
FROM one o JOIN conf USING (query_id) LEFT JOIN ts USING (query_id) LEFT JOIN cov USING (query_id)""")
def evidence_grade(spark: SparkSession, sf: str) -> DataFrame:
    best = surely(retrieval.diverse(candidates(spark, sf, carry=("chunk_text",)), 1, 0.5, 3))
    words = asked(spark, sf).select("query_id", F.filter(text.query_terms(F.col("text")), lambda t: F.char_length(t).between(3, 21)).alias("terms"))
    rows = best.where("rank = 1").join(words, "query_id")
    covered = F.size(F.filter("terms", lambda t: F.contains(F.lower("chunk_text"), t)))
    return rows.select("query_id", "confidence", long(covered, "covered"), scoring.evidence_grade(F.col("confidence"), F.col("cosine"), 0.5, covered, F.size("terms")).alias("grade"))


@query("""SELECT label AS set_id, CASE WHEN max(s) < 0.6 THEN 'low' WHEN max(s) >= 0.70 OR count_if(s >= 0.65) >= 2 THEN 'strong' ELSE 'standard' END AS at_60,
CASE WHEN greatest(max(s), arg_min(s, vec_id)) >= 0.70 OR count_if(s >= 0.65) >= 2 THEN 'strong' ELSE 'standard' END AS stored FROM (SELECT vec_id, label, (vec_id % 71) / 100.0 AS s FROM embeddings WHERE label IS NOT NULL) GROUP BY label""")
def match_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "embeddings")[0].where("label IS NOT NULL").withColumn("s", F.col("vec_id") % 71 / 100.0)
    # the score that matters is the top one and whether two agree: a bounded summary, not a group's list
    found = rows.groupBy("label").agg(F.max("s").alias("top"), F.count_if(F.col("s") >= 0.65).alias("n"), F.min_by("s", "vec_id").alias("own"))
    scores = F.when(F.col("n") >= 2, F.array("top", F.lit(0.65))).otherwise(F.array("top"))
    return found.select(F.col("label").alias("set_id"), scoring.match_confidence(scores, 0.6).alias("at_60"), scoring.stored_confidence(F.col("own"), F.when(F.col("n") >= 2, F.array("top", F.lit(0.65), F.lit(0.65))).otherwise(F.array("top"))).alias("stored"))


#: sentence ends of the driver's languages beside the usual ones
ENDS = ".!?;" + evidence.MARKS
SPLIT = "list_filter(list_transform(regexp_extract_all({}, '[^" + ENDS + "]+[" + ENDS + "]?'), lambda v: trim(v)), lambda v: v <> '')"
FOLDED = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^0-9a-z一-鿿]+', '', 'g')"
PAIRS = "CASE WHEN length({0}) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, CAST(i AS INT), 2))) END"


def support_sql(sentence: str, units: str) -> str:
    """SQL of evidence.support() for one answer; units: the sentence's bigrams."""
    return f"""round((CASE WHEN answer <> '' AND contains({sentence}, answer) THEN 120.0 ELSE 0.0 END) + 90 * (CASE WHEN len(ba) = 0 THEN 0.0 ELSE CAST(len(list_intersect(ba, {units})) AS DOUBLE) / len(ba) END)
  + coalesce(list_sum(list_transform(list_filter(stems, lambda t: contains({sentence}, t)), lambda t: least(8, length(t)))), 0)
  + CASE WHEN regexp_matches(stem, '{evidence.ASKS}') AND regexp_matches({sentence}, '{evidence.DEFINES}') THEN 18.0 ELSE 0.0 END
  - CASE WHEN regexp_matches({sentence}, '{evidence.CONTENTS}') AND NOT (answer <> '' AND contains({sentence}, answer)) THEN 12.0 ELSE 0.0 END, 6)"""


ANSWERS = r"""
asks AS (SELECT item_id AS query_id, text AS stem, string_split_regex(text, '[\s，。；：、？！“”‘’（）()]+') AS p FROM benchmark),
longest AS (SELECT query_id, (max({'n': length(t), 't': t})).t AS answer FROM (SELECT query_id, unnest(p) AS t FROM asks) GROUP BY query_id),
answers0 AS (SELECT query_id, stem, answer, list_filter(p, lambda t: length(t) BETWEEN 2 AND 24) AS stems, FOLDED AS ka FROM asks JOIN longest USING (query_id)),
answers AS (SELECT query_id, stem, answer, stems, PAIRS AS ba FROM answers0)""".replace("FOLDED", FOLDED.format("answer")).replace("PAIRS", PAIRS.format("ka"))
SENTENCES = CANDIDATES + "," + ANSWERS + r""",
picked AS (SELECT query_id, chunk_id, doc_id, book, cosine, chunk_text, trim(regexp_replace(chunk_text, '\s+', ' ', 'g')) AS quote FROM cand JOIN (SELECT chunk_id, chunk_text FROM chunks) USING (chunk_id)),
sent AS (SELECT query_id, chunk_id, doc_id, book, cosine, chunk_text, quote, unnest(p) AS sentence, unnest(generate_series(1, len(p))) - 1 AS pos FROM (SELECT *, SPLIT AS p FROM picked)),
big AS (SELECT *, FOLDED AS ks FROM sent JOIN answers USING (query_id)),
big2 AS (SELECT *, PAIRS AS bs FROM big),
scored AS (SELECT *, SUPPORT AS support FROM big2)""".replace("SPLIT", SPLIT.format("quote")).replace("FOLDED", FOLDED.format("sentence")).replace("PAIRS", PAIRS.format("ks")).replace("SUPPORT", support_sql("sentence", "bs"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The questions with their longest word as the keyed answer."""
    words = F.transform(F.split("text", evidence.PARTS), lambda t: F.struct(F.char_length(t).alias("n"), t.alias("t")))
    return asked(spark, sf).select("query_id", F.array(F.array_max(words)["t"]).alias("answers"), F.col("text").alias("stem"))


def supported(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return evidence.scored_sentences(candidates(spark, sf, carry=("chunk_text",)), questions(spark, sf), keep, ENDS)


@query(SENTENCES + " SELECT query_id, chunk_id, CAST(pos AS BIGINT) AS pos, md5(sentence) AS sentence_md5, support FROM scored")
def sentence_support(spark: SparkSession, sf: str) -> DataFrame:
    scored = supported(spark, sf)
    return scored.select("query_id", "chunk_id", long("at", "pos"), F.md5("sentence").alias("sentence_md5"), "support")


@query(SENTENCES + r""",
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY support DESC, pos) AS r FROM scored),
lined AS (SELECT query_id, chunk_id, quote, list_filter(list_transform(string_split(chunk_text, chr(10)), lambda l: trim(trim(regexp_replace(l, '\s+', ' ', 'g')), ' ' || chr(9) || '|·')), lambda l: l <> '' AND NOT regexp_matches(l, 'NOISE')) AS ls FROM picked),
cleaned AS (SELECT query_id, chunk_id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, ' ') ELSE quote END AS clean FROM lined),
told AS (SELECT query_id, chunk_id, clean, SPLIT AS p FROM cleaned),
each AS (SELECT query_id, chunk_id, unnest(p) AS sentence, unnest(generate_series(1, len(p))) AS pos FROM told),
folded AS (SELECT *, FOLDED AS ks FROM each JOIN answers USING (query_id)),
judged AS (SELECT *, SUPPORT AS support FROM (SELECT *, PAIRS AS bs FROM folded)),
top AS (SELECT query_id, chunk_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY support DESC, pos) AS r FROM judged) WHERE r = 1),
near AS (SELECT query_id, chunk_id, string_agg(sentence, '' ORDER BY e.pos) AS context FROM each e JOIN top t USING (query_id, chunk_id) WHERE e.pos BETWEEN t.pos - 1 AND t.pos + 1 GROUP BY ALL),
ctx AS (SELECT query_id, chunk_id, CASE WHEN len(p) > 1 THEN context WHEN strpos(clean, substr(p[1], 1, 240)) = 0 THEN substr(clean, 1, 320) ELSE substr(clean, CAST(greatest(0, strpos(clean, substr(p[1], 1, 240)) - 81) AS INT) + 1, CAST(strpos(clean, substr(p[1], 1, 240)) - 1 + length(substr(p[1], 1, 240)) + 160 - greatest(0, strpos(clean, substr(p[1], 1, 240)) - 81) AS INT)) END AS context FROM told JOIN near USING (query_id, chunk_id)),
found AS (SELECT query_id, chunk_id, substr(sentence, 1, 240) AS excerpt, support, quote, answer, list_filter(list_transform(p, lambda t: trim(regexp_replace(t, '^[A-E][.、．:]?', ''))), lambda t: length(t) BETWEEN 2 AND 24) AS named FROM b JOIN asks USING (query_id) WHERE r = 1)
SELECT query_id, chunk_id, md5(excerpt) AS excerpt_md5, support, md5(substr(trim(regexp_replace(context, '\s+', ' ', 'g')), 1, 320)) AS context_md5,
  (SELECT coalesce(string_agg(t, '|' ORDER BY i), '') FROM (SELECT t, min(i) AS i FROM (SELECT unnest(list_prepend(answer, named)) AS t, unnest(generate_series(1, len(named) + 1)) AS i) WHERE length(t) BETWEEN 2 AND 120 AND contains(excerpt, t) AND contains(quote, t) GROUP BY t ORDER BY i LIMIT 8)) AS highlights
FROM found JOIN ctx USING (query_id, chunk_id)""".replace("NOISE", evidence.NOISE).replace("SPLIT", SPLIT.format("clean")).replace("FOLDED", FOLDED.format("sentence")).replace("PAIRS", PAIRS.format("ks")).replace("SUPPORT", support_sql("sentence", "bs")))
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf, carry=("chunk_text",)).join(questions(spark, sf), "query_id")
    found = evidence.excerpts(rows.select("query_id", "chunk_id", F.col("chunk_text").alias("quote"), "answers", "stem", F.col("stem").alias("question")), ENDS)
    return found.where("support IS NOT NULL").select("query_id", "chunk_id", F.md5("excerpt").alias("excerpt_md5"), "support", F.md5("context").alias("context_md5"), F.array_join("highlights", "|").alias("highlights"))


@query(SENTENCES + r""",
g2 AS (SELECT *, PAIRS AS bc FROM (SELECT *, FOLDED AS kc FROM scored))
SELECT query_id, chunk_id, CAST(pos AS BIGINT) AS pos, length(sentence) >= 20 AND len(bs) > 0 AND len(list_intersect(bs, bc)) >= len(bs) * 0.55 AND len(list_filter(regexp_extract_all(sentence, '[0-9]+(?:\.[0-9]+)?%?'), lambda n: NOT contains(chunk_text, n))) = 0 AS grounded FROM g2""".replace("FOLDED", FOLDED.format("chunk_text")).replace("PAIRS", PAIRS.format("kc")))
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    return supported(spark, sf, ("chunk_text",)).select("query_id", "chunk_id", long("at", "pos"), evidence.grounded(F.col("sentence"), F.col("chunk_text")).alias("grounded"))


@query(SENTENCES + """,
e AS (SELECT query_id, chunk_id, book, doc_id, cosine, max(support) AS support FROM scored GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, cosine DESC, chunk_id) AS r, max(cosine) OVER (PARTITION BY query_id) AS best FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, book, doc_id % 2 ORDER BY support DESC, cosine DESC, chunk_id) AS b FROM o WHERE r = 1 OR (support > 0 AND cosine >= greatest(0.55, round(best - 0.15, 9))))
SELECT query_id, chunk_id, book, 'E' || CAST(k AS VARCHAR) AS evidence_id, support FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, cosine DESC, chunk_id) AS k FROM f WHERE b = 1) WHERE k <= 4""")
def best_evidence(spark: SparkSession, sf: str) -> DataFrame:
    best = supported(spark, sf, ("book", "doc_id", "cosine")).groupBy("query_id", "chunk_id", "book", "doc_id", "cosine").agg(F.max("support").alias("support"))
    found = best.select("query_id", "chunk_id", "book", (F.col("doc_id") % 2).alias("version"), "support", F.col("cosine").alias("score"), F.col("chunk_id").alias("at"))
    return evidence.best_evidence(found).select("query_id", "chunk_id", "book", "evidence_id", "support")


@query(r"""WITH x AS (SELECT item_id, item_id % 7 = 0 AS hard, contains(lower(text), 'the') AS is_case, item_id % 3 = 1 AS b, regexp_matches(text, '[0-9]') AS calc, item_id % 5 AS answers, length(text) AS n FROM benchmark),
y AS (SELECT *, (CASE WHEN hard THEN 3 ELSE 0 END) + (CASE WHEN is_case THEN 2 ELSE 0 END) + (CASE WHEN b THEN 2 ELSE 0 END) + (CASE WHEN calc THEN 2 ELSE 0 END) + (CASE WHEN answers >= 3 THEN 1 ELSE 0 END) + (CASE WHEN n >= 320 THEN 1 ELSE 0 END) AS points FROM x)
SELECT item_id, CAST(points AS BIGINT) AS points, CASE WHEN points >= 3 THEN 'pro' WHEN points >= 1 THEN 'thinking' ELSE 'fast' END AS tier, concat_ws(',', CASE WHEN hard THEN 'hard' END, CASE WHEN is_case THEN 'case' END, CASE WHEN b THEN 'grade_b' END, CASE WHEN calc THEN 'calculation' END, CASE WHEN answers >= 3 THEN 'answers' END, CASE WHEN n >= 320 THEN 'long' END) AS reasons FROM y""")
def generation_route(spark: SparkSession, sf: str) -> DataFrame:
    (rows,) = tables(spark, sf, "benchmark")
    points, tier, reasons = scoring.generation_route(F.col("item_id") % 7 == 0, F.contains(F.lower("text"), F.lit("the")), F.col("item_id") % 3 == 1, F.col("text").rlike("[0-9]"), F.col("item_id") % 5, F.char_length("text"))
    return rows.select("item_id", long(points, "points"), tier.alias("tier"), F.array_join(reasons, ",").alias("reasons"))


# --- evaluation -------------------------------------------------------------------------------------------------------

JUDGED = """WITH t AS (SELECT vec_id AS query_id, CASE vec_id % 40 WHEN 0 THEN 'A' ELSE 'B' END AS grade, label, embedding FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL),
near AS (SELECT t.query_id, t.grade, v.vec_id, round(list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cosine, t.label = v.label AS relevant FROM t JOIN embeddings v ON v.vec_id <> t.query_id AND v.embedding IS NOT NULL),
c AS (SELECT query_id, grade, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS chunk_id, cosine, round(((vec_id * 37 + query_id * 11) % 101) / 100.0, 6) AS rerank, coalesce(relevant, false) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM near) WHERE r <= 20),
sizes AS (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY label),
truths AS (SELECT t.query_id, t.grade, coalesce(s.n, 1) - 1 AS n_truth FROM t LEFT JOIN sizes s ON t.label = s.label)"""


def measured_sql(name: str, score: str, accept: str, keys: str = "") -> str:
    """CTEs name_q and name: metrics of those of c that accept holds for, ranked by score; keys: of a grid, '' if none."""
    k = f"{keys}, " if keys else ""
    every = f"(SELECT * FROM truths CROSS JOIN settings)" if keys else "truths"
    on = f"USING ({k}query_id)"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_r AS (SELECT {k}query_id, chunk_id, relevant, row_number() OVER (PARTITION BY {k}query_id ORDER BY {score} DESC, chunk_id) AS r FROM c {'CROSS JOIN settings' if keys else ''} WHERE {accept}),
{name}_o AS (SELECT {k}query_id, count(*) AS n_pred, min(CASE WHEN relevant THEN r END) AS hit FROM {name}_r WHERE r <= 3 GROUP BY {k}query_id),
{name}_q AS (SELECT {k}query_id, grade, n_truth > 0 AS truth, hit IS NOT NULL AS h, coalesce(n_pred, 0) AS n_pred, hit FROM {every} LEFT JOIN {name}_o {on}),
{name}_g AS (SELECT {k}grade, CAST(count_if(truth AND h) AS DOUBLE) AS tp, CAST(count_if(n_pred > 0 AND NOT h) AS DOUBLE) AS fp, CAST(count_if(truth AND NOT h) AS DOUBLE) AS fn, CAST(count_if((truth AND h) OR (NOT truth AND n_pred = 0)) AS DOUBLE) AS rec, sum(CASE WHEN h THEN 1.0 / hit ELSE 0 END) AS rr, count(*) AS n FROM {name}_q GROUP BY {k}grade),
{name}_f AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS rc FROM {name}_g),
{name} AS (SELECT {k}round(avg(2 * p * rc / greatest(1e-12, p + rc)), 6) AS f1, round(avg(rec / n), 6) AS macro_recall, round(sum(rec) / sum(n), 6) AS recall_at_3, round(sum(rr) / sum(n), 6) AS mrr_at_3, round(sum(fp) / greatest(1, sum(fp) + sum(tp)), 6) AS false_match_rate, CAST(sum(n) AS BIGINT) AS n_queries FROM {name}_f {group})"""


def judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The 20 nearest of all vectors to each whose id is divisible by 20; relevant if of the same label, of all there are."""
    e = tables(spark, sf, "embeddings")[0].where("embedding IS NOT NULL")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 40 == 0, "A").otherwise("B").alias("grade"), "label", F.col("embedding").alias("vector"))
    near = evaluation.nearest(q.select("query_id", "vector"), e.select("vec_id", F.col("embedding").alias("vector")), 20).join(q.select("query_id", "grade", F.col("label").alias("own")), "query_id").join(e.select("vec_id", "label"), "vec_id")
    rows = near.select("query_id", "grade", F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("chunk_id"), "cosine", F.round((F.col("vec_id") * 37 + F.col("query_id") * 11) % 101 / 100.0, 6).alias("rerank"), F.coalesce(F.col("own") == F.col("label"), F.lit(False)).alias("relevant"))
    sizes = e.groupBy("label").agg(F.count("*").alias("n"))
    truths = q.select("query_id", "grade", "label").join(sizes, "label", "left").select("query_id", "grade", (F.coalesce("n", F.lit(1)) - 1).alias("n_truth"))
    return kept(rows), kept(truths)


def measured(rows: DataFrame, truths: DataFrame, alpha: float, threshold: float) -> DataFrame:
    score = F.round(scoring.hybrid_score(F.col("cosine"), F.col("rerank"), alpha), 9)
    return evaluation.metrics(evaluation.outcomes(rows, truths, score >= threshold, score), truths)


def hybrid_sql(alpha: float) -> str:
    return f"round({alpha} * (cosine + 1) / 2 + (1 - {alpha}) * rerank, 9)"


@query(JUDGED + "," + measured_sql("m", hybrid_sql(0.25), hybrid_sql(0.25) + " >= 0.6") + " SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return measured(*judged(spark, sf), 0.25, 0.6)


ALPHAS, THRESHOLDS = [i / 20 for i in range(21)], [0.3 + i / 100 for i in range(61)]
GRID = "settings AS (SELECT a * 61 + t AS setting, a / 20.0 AS alpha, 0.3 + t / 100.0 AS threshold FROM range(21) x(a) CROSS JOIN range(61) y(t))"


@query(JUDGED + "," + measured_sql("b", "cosine", "cosine >= 0.5") + "," + GRID.replace("a / 20.0", "CAST(a AS DOUBLE) / 20").replace("0.3 + t / 100.0", "CAST(0.3 AS DOUBLE) + CAST(t AS DOUBLE) / 100") + "," + measured_sql("m", "round(alpha * (cosine + 1) / 2 + (1 - alpha) * rerank, 9)", "round(alpha * (cosine + 1) / 2 + (1 - alpha) * rerank, 9) >= threshold", "setting, alpha, threshold") + """
SELECT alpha, round(threshold, 6) AS threshold, f1, recall_at_3, mrr_at_3, false_match_rate, (SELECT min(n) >= 30 FROM (SELECT count(*) AS n FROM truths GROUP BY grade)) AS enabled FROM m WHERE false_match_rate <= (SELECT false_match_rate FROM b) + 1e-12
ORDER BY f1 DESC, recall_at_3 DESC, mrr_at_3 DESC, false_match_rate, setting LIMIT 1""")
def calibrate_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows, truths = judged(spark, sf)
    base = evaluation.metrics(evaluation.outcomes(rows, truths, F.col("cosine") >= 0.5, F.col("cosine")), truths)
    limit = base.select("false_match_rate").first()[0]
    return evaluation.grid_search(rows, truths, ALPHAS, THRESHOLDS, limit).withColumn("threshold", F.round("threshold", 6))


@query(JUDGED + "," + measured_sql("b", hybrid_sql(1.0), hybrid_sql(1.0) + " >= 0.75") + "," + measured_sql("m", hybrid_sql(0.25), hybrid_sql(0.25) + " >= 0.6") + """
SELECT round(m.recall_at_3 - b.recall_at_3, 6) AS delta_recall, round(m.mrr_at_3 - b.mrr_at_3, 6) AS delta_mrr, m.false_match_rate <= b.false_match_rate AND ((round(m.recall_at_3 - b.recall_at_3, 6) >= 0.03 AND round(m.mrr_at_3 - b.mrr_at_3, 6) >= 0) OR (round(m.mrr_at_3 - b.mrr_at_3, 6) >= 0.03 AND round(m.recall_at_3 - b.recall_at_3, 6) >= 0)) AS passed FROM m CROSS JOIN b""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows, truths = judged(spark, sf)
    return evaluation.quality_gate(measured(rows, truths, 1.0, 0.75), measured(rows, truths, 0.25, 0.6))


@query("""WITH j AS (SELECT d.doc_id, CAST(quality AS VARCHAR) AS grade, lang, source FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY grade, lang, source ORDER BY doc_id) AS turn FROM j),
p AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY turn, lang, source, doc_id) AS place FROM r WHERE turn <= 80)
SELECT doc_id, grade, lang, source, CAST(place AS BIGINT) AS place FROM p WHERE place <= 80""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = tables(spark, sf, "documents", "labels")
    rows = docs.select("doc_id", "lang", "source").join(labels, "doc_id").withColumn("grade", F.col("quality").cast("string"))
    return evaluation.stratified(rows, "grade", ["lang", "source"], "doc_id").select("doc_id", "grade", "lang", "source", long("place"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN value END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.nearest_rank("value", ["event_type"], {"p50": 0.5, "p95": 0.95}, tables(spark, sf, "events")[0])


@query("""SELECT user_id, round(count_if(event_type = 'purchase') * 60.0 / greatest(1, date_diff('second', min(ts), max(ts))), 4) AS per_minute, round(count_if(event_type = 'error') / greatest(1.0, CAST(count_if(event_type IN ('error', 'purchase')) AS DOUBLE)), 4) AS failure_rate FROM events GROUP BY user_id""")
def throughput_rates(spark: SparkSession, sf: str) -> DataFrame:
    (rows,) = tables(spark, sf, "events")
    done, failed = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    seconds = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return rows.groupBy("user_id").agg(F.round(done * 60.0 / F.greatest(F.lit(1), seconds), 4).alias("per_minute"), F.round(failed / F.greatest(F.lit(1.0), (done + failed).cast("double")), 4).alias("failure_rate"))

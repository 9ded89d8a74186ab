"""The queries op1 to op13 of this subpackage and, where SQL can express one, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import ppm_score

    return ppm_score(read(spark, sf_dir, "documents"))


def op2_rabitq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rabitq import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import report

    return report(read(spark, sf_dir, "documents"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_score

    return toxicity_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ftrl import ftrl_score

    return ftrl_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reshard import resharded

    placed, _ = resharded(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import replicated

    mixed = replicated(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_copies", "copy", "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op10_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cdc import deduplicated

    found = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_repeated", gone.cast("long").alias("removed_bytes"), (F.col("text_bytes") - gone).alias("kept_bytes"), "removed", F.md5("text").alias("kept_md5"))


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_embedding import fingerprint_report

    return fingerprint_report(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that have any: pairs by definition, mixing by the same hash and tables, audits by flag patterns."""
    return {
        "op2_rabitq_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.x = comp.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp""",
        "op6_partenum_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = s.doc_id) AS component_id FROM s""",
        "op9_poisson_mixing": """
WITH sizes AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT source, pow(size, 0.7) / (SELECT sum(pow(size, 0.7)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS reached FROM rates CROSS JOIN (SELECT unnest(generate_series(0, 200)) AS k)),
drawn AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text_md5, CAST(count_if(u >= reached) AS BIGINT) AS n FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
copies AS (SELECT doc_id, source, text_md5, CAST(n AS INTEGER) AS n_copies, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM counted WHERE n > 0)
SELECT doc_id, source, n_copies, copy, CAST(('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 12)) AS BIGINT) / 281474976710656.0 AS shuffle_key, text_md5 FROM copies""",
        "op12_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda k: CAST(CAST('0x' || substr(x, 2 * k + 1, 2) AS INTEGER) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM hexed, crc),
cut AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
gaps AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words)),
half AS (SELECT a.word AS a, b.word AS b FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word < b.word UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.rest = w.word),
pairs AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
best AS (SELECT p.a AS word, CAST(count(*) AS BIGINT) AS n_near, min({'less': -w.n, 'other': p.b}) AS m FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.m.less >= 10 * w.n THEN b.m.other END AS form, CASE WHEN -b.m.less >= 10 * w.n THEN -b.m.less END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS last, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON c.last = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM formed f JOIN roots r ON f.word = r.word""",
        "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT x, min(doc_id) AS first FROM d GROUP BY x),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(d.doc_id > f.first, false)] AS fails FROM d JOIN firsts f USING (x) LEFT JOIN marks m ON d.doc_id = m.doc_id),
patterns AS (SELECT part, good, toxic, fails, len(list_filter(fails, lambda y: y)) AS n_fails, count(*) AS docs FROM flags GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
replay AS (SELECT part, good, toxic, n_fails, docs, o, step, fails[o[step]] AS failing, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone FROM patterns, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
summed AS (SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step,
 coalesce(sum(docs) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(docs) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(docs) FILTER (gone AND failing), 0) AS redundant,
 coalesce(sum(docs) FILTER (failing AND n_fails = 1), 0) AS unique_fails, coalesce(sum(docs) FILTER (NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(docs) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost FROM replay GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM summed""",
    }

"""Fingerprints, spelling variants and the audit of filters: by definition on small tables, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from lodestone.llm import edit_embedding, filter_audit, queries, spelling

SCHEMA = "doc_id long, text string, lang string"
LONG = "pneumonoultramicroscopic " * 3 + "lorem ipsum dolor " * 20_000
ODD = [
    (1, "Colour colour colour neighbour neighbours #1", "en"), (2, "Colour colour colour neighbour neighbours #1", "en"), (3, None, None), (4, "", "fr"), (5, " \t\n\x0b\x0c\r ", "fr"),
    (6, "élégance élégances ELEGANCE 梦 ☃ 😀", "fr"), (7, LONG, "en"), (7, LONG, "en"), (None, "no id here, nowhere, neighbour", "en"), (None, "", None), (8, "x" * 5000, "en"), (9, "one", None), (10, "one", ""),
]
CLASH = ["part", "step", "kept", "word", "n", "root", "form", "gram", "at", "key", "block", "tail", "before", "digest", "good", "toxic", "fingerprint", "id"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (8, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_filter_audit"])
def test_query_equals_its_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    root = {}
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], words[w], len(near[w]), words.get(form[w])) for w in words}


def test_variants_of_random_words(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab", "babababa"]
    words = {w: rng.choice([2, 3, 20, 25, 300, 3000, 30000]) for w in stems}
    for w in list(words):
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcz")
            words.setdefault(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]), rng.choice([2, 2, 5, 40, 500]))
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    assert len(rows) == len(words) and set(rows) == plain_variants(words)
    assert any(r[2] != r[1] and r[1] for r in rows), "no chain of two steps"


def test_variants_of_odd_rows(spark, odd, empty):
    found = spelling.spelling_variants(odd)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == plain_variants(plain_words(ODD))
    assert spelling.spelling_variants(empty).count() == 0


def test_one_edit_by_definition(spark):
    words = ["".join(w) for k in range(5) for w in itertools.product("aé", repeat=k)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words if len(b) - len(a) in (0, 1)], "a string, b string")
    for r in pairs.withColumn("near", spelling.one_edit(F.col("a"), F.col("b"))).collect():
        assert r.near == one_edit(r.a, r.b), r


def test_variants_at_the_limit_of_long_words(spark, monkeypatch):
    words = {"a" * k + x: 2 + k for k in range(8, 13) for x in ("", "b", "c")}
    for long in (9, 10, 11):
        monkeypatch.setattr(spelling, "LONG", long)
        found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == plain_variants(words)


def test_words_may_be_very_long(spark):
    word = "ab" * 50_000
    rows = spark.createDataFrame([(1, f"{word} {word} {word}x {word}x", "en")], SCHEMA)
    assert {(len(r.word), r.n_near) for r in spelling.spelling_variants(rows).collect()} >= {(100_000, 1), (100_001, 1)}


# --- audit of filters


def plain_audit(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text]}
        docs.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, total = [], Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = [d for d in docs if d[0] == part and x in d[1]]
                total[part, x] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(bool(d[1] & set(order[: step - 1])) for d in failing), sum(d[1] == {x} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return {(*r, total[r[0], r[1][r[2] - 1]]) for r in out}


def test_audit_of_odd_rows(spark, odd, empty, labels):
    found = filter_audit.filter_audit(odd, labels.withColumns({c: F.lit("clash") for c in ("id", "good", "text", "lang")}))
    rows = [tuple(r) for r in found.collect()]
    expected = plain_audit(ODD, [tuple(r) for r in labels.collect()])
    assert len(rows) == len(expected) == 600 * 3 and set(rows) == expected
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert filter_audit.filter_audit(odd, labels.limit(0)).agg(F.max("good_lost"), F.max("toxic_lost")).first() == (0, 0)


def test_each_filter_works_at_its_limits(spark):
    def failing(text):
        rows = spark.createDataFrame([(1, text, "en")], SCHEMA)
        return "".join(x for x, y in zip("ABCDE", filter_audit.flagged(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first().fails) if y)

    words = [f"w{i}" for i in range(200)]
    assert failing(" ".join(words)) == "" and failing(" ".join(words[1:])) == "A"
    assert failing(" ".join(words[:100] * 2)) == "" and failing(" ".join(words[:99] + words[:101 - 2] + ["w0", "w1"])) == "B"
    assert failing(" ".join(words) + " " * (1000 - len(" ".join(words)) - 30) + "A" * 30) == "" and failing(" ".join(words) + " " * (1000 - len(" ".join(words)) - 31) + "A" * 31) == "C"
    assert failing(" ".join(words) + "|") == "D"


# --- fingerprints


def plain_walk(kinds, steps):
    """The embedding step by step: what each step stands on."""
    out, i, j = [], 0, 0
    while i < len(kinds):
        out.append(i)
        i += steps[kinds[i] * edit_embedding.PERIOD + j % edit_embedding.PERIOD] == 1
        j += 1
    return out


def test_walks_by_definition():
    walker, rng = edit_embedding.Walker(), np.random.default_rng(3)
    for lengths in ([7, 0, 300, 1], rng.integers(0, 200, 120).tolist()):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        kinds = rng.integers(0, edit_embedding.CLASSES, offsets[-1])
        for walk in range(edit_embedding.WALKS):
            reached, total = walker.walked(kinds, offsets, np.argsort(-np.diff(offsets), kind="stable"), walk)
            for t in range(len(lengths)):
                made = plain_walk(kinds[offsets[t] : offsets[t + 1]], walker.steps[walk])
                assert total[t] == len(made)
                assert reached[offsets[t] : offsets[t + 1]].tolist() == [made.index(i) for i in range(lengths[t])]


def test_places_are_spread_evenly_and_change_seldom():
    places = edit_embedding._places()
    chosen = lambda n: np.array([p[np.searchsorted(p, n, "left") - 1] for p in places])
    assert (chosen(1) == 0).all() and chosen(1000).max() < 1000
    assert abs(chosen(10_000).mean() - 5000) < 700
    assert (chosen(10_000) == chosen(9_800)).mean() > 0.93


def test_likeness_follows_edits():
    rng, walker = random.Random(8), edit_embedding.Walker()
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(4000))

    def edits(text, n):
        for _ in range(n):
            i = rng.randrange(len(text))
            text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
        return text

    half = base[:2000] + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(2000))
    other = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(4000))
    made = walker.digits([base, base, edits(base, 2), edits(base, 40), half, other, "y" + base])
    like = [edit_embedding.likeness(made[:1], made[i : i + 1])[0] for i in range(1, 7)]
    assert like[0] == 1 and like[1] > 0.85 and like[2] > 0.3 and 0.4 < like[3] < 0.62 and like[4] < 0.1 and like[5] > 0.9


def plain_report(rows):
    walker = edit_embedding.Walker()
    ordered = sorted(((d is not None, d or 0, t or "") for d, t, *_ in rows))
    out = []
    for (some, d, text), (_, _, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        made = walker.digits([text, changed, after])
        like = lambda i: round(float(edit_embedding.likeness(made[:1], made[i : i + 1])[0]), 9)
        out.append((d if some else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), *edit_embedding.written(made[:2]), like(1), like(2)))
    return sorted(out, key=repr)


def result(found):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in found.collect()), key=repr)


def test_report_of_odd_rows(spark, odd, empty):
    assert result(edit_embedding.fingerprint_report(odd)) == plain_report(ODD)
    assert edit_embedding.fingerprint_report(empty).count() == 0
    one = edit_embedding.fingerprint_report(spark.createDataFrame([(5, "a single text", "en")], SCHEMA)).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a singla sing").hexdigest()


def test_report_over_many_blocks_and_batches(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(10**9) if i % 9 else i // 18, "".join(rng.choice("abcde ") for _ in range(rng.randrange(400))), "en") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = result(edit_embedding.fingerprint_report(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == plain_report(rows)
    walker, texts = edit_embedding.Walker(), [r[1] for r in rows]
    monkeypatch.setattr(edit_embedding, "BATCH", 3000)
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": list(range(300)), "text": texts, "block": [0] * 300, "tail": [False] * 299 + [True]})
    made = pa.Table.from_batches(edit_embedding._fingerprinted(iter([batch.slice(0, 100), batch.slice(100)])))
    assert made["fingerprint"].to_pylist() == edit_embedding.written(walker.digits(texts[:-1]))
    assert made["doc_id"].to_pylist() == list(range(299))


def test_edited_texts_are_nearer_than_others(spark, sf):
    found = queries.op11_edit_fingerprints(spark, sf)
    n = found.where("n_chars > 100").count()
    assert found.where("n_chars > 100 AND near_edited > 0.3").count() > 0.97 * n
    assert found.where("n_chars > 100 AND near_next < 0.2").count() > 0.9 * n
    texts = spark.read.parquet(f"{sf}/documents.parquet").join(found, "doc_id")
    assert texts.groupBy("text").agg(F.countDistinct("fingerprint").alias("k")).where("k > 1").count() == 0


def test_bands_find_near_texts(spark):
    rng = random.Random(4)
    base = " ".join(rng.choice(["tree", "house", "river", "stone", "cloud", "night"]) for _ in range(500))
    rows = edit_embedding.fingerprints(spark.createDataFrame([(1, base, "en"), (2, base[:900] + "!" + base[900:], "en"), (3, None, "en")], SCHEMA).withColumn("bands", F.lit(1)))
    keys = rows.select("doc_id", F.explode(edit_embedding.bands(F.col("fingerprint"))).alias("band"))
    met = keys.alias("a").join(keys.alias("b"), "band").where("a.doc_id < b.doc_id").select("a.doc_id", F.col("b.doc_id").alias("other")).distinct()
    assert [tuple(r) for r in met.collect()] == [(1, 2)]

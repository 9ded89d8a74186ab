"""Each operator against brute force on small tables, and on rows with nulls, empty and long texts, ties and repeats."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import cdc, components, ftrl, mixing, partenum, ppm, quality_rules, rabitq, reshard, spm, textkit, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "Alpha beta GAMMA delta\nepsilon zeta eta theta iota kappa lambda mu", "a"),
    (2, "alpha beta gamma delta\nepsilon zeta eta theta iota kappa lambda mu", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, " \t\n\x0b\x0c\r ", "b"),
    (6, "é ß 梦 ☃ " * 5, "b"),
    (7, LONG, "c"),
    (7, LONG, "c"),
    (None, "no id here", "c"),
    (8, "x" * 5000, "c"),
    (9, "one", None),
    (10, "one", "a"),
]
SCHEMA = "doc_id long, text string, source string"
CLASH = ["score", "kept", "n", "sig", "block", "spans", "ids", "copy", "rate", "size", "component_id", "key", "label", "held_out"]


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# --- text primitives ---


def test_words_and_windows_follow_their_definition():
    found = [t or "" for _, t, _ in ODD]
    for limit in (16, 1 << 20):
        for part in textkit.slices(pa.array([t for _, t, _ in ODD]), limit):
            start, end = part.bounds
            mine = [bytes(part.raw[a:b]).decode() for a, b in zip(start, end, strict=True)]
            theirs = [w for t in found[part.first : part.first + len(part)] for w in WORD.findall(t)]
            assert mine == theirs
            names = {}
            for w, h in zip(map(lower, mine), part.words().tolist(), strict=True):
                assert names.setdefault(w, h) == h
            assert len(set(names.values())) == len(names)
            _, offsets = textkit.shingles(part, 3)
            for i in range(len(part)):
                w = [lower(x) for x in WORD.findall(found[part.first + i])]
                n = len({tuple(w[j : j + 3]) for j in range(len(w) - 2)}) if len(w) >= 3 else int(bool(w))
                assert offsets[i + 1] - offsets[i] == n


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000))
    table = textkit.Lookup(keys, np.arange(len(keys)), -1)
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (textkit.Lookup(np.zeros(0, np.int64), np.zeros(0), 7.0).get(keys[:3]) == 7).all()


def test_components(spark):
    edges = [(1, 2), (3, 2), (10, 9), (9, 8), (8, 7), (5, 5)] + [(100, i) for i in range(101, 160)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (7, 8, 9, 10)} == {7} and {got[i] for i in range(100, 160)} == {100} and 5 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: PPM ---


def slow_ppm(train, text, order):
    """Counts by dictionary, escape method C, exclusion by symbol sets."""
    counts = Counter()
    follows = {}
    for t in train:
        s = [0] * order + [b + 2 for b in t] + [1]
        for i in range(order, len(s)):
            for k in range(order + 1):
                follows.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    del counts
    total = 0.0
    s = [0] * order + [b + 2 for b in text] + [1]
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            seen = follows.get(tuple(s[i - k : i]))
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in out}
            if not left:
                continue
            n, d = sum(left.values()), len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / (n + d))
                break
            total += math.log10(d / (n + d))
            out |= set(seen)
        else:
            total -= math.log10(257 - len(out))
    return total


@pytest.mark.parametrize("order", [1, 3, 5])
def test_ppm_equals_a_slow_one(spark, texts, order):
    rows = [(i, t[:400]) for i, t in list(texts.items())[:60]]
    got = {r.doc_id: r for r in ppm.ppm_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = [lower(t) for i, t in rows if not out[i]]
    vocabulary = Counter(w for t in train for w in WORD.findall(t))
    n, v = sum(vocabulary.values()) + len(train), len(vocabulary) + 1
    for i, t in rows:
        words = WORD.findall(lower(t))
        base = sum(math.log10((vocabulary[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (out[i], len(words) + 1, n, sum(w in vocabulary for w in words) + 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(slow_ppm([x.encode() for x in train], lower(t).encode(), order), rel=1e-9)


def test_ppm_on_odd_rows(odd, empty):
    got = ppm.ppm_score(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert ppm.ppm_score(empty).count() == 0


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_ppm_moves_no_row_for_each_gram_of_each_block(spark, docs, tmp_path):
    """Six files of the same texts are six blocks with the same grams: what is shuffled grows by texts and parts alone."""
    moved = []
    for copies in (1, 6):
        for i in range(copies):
            docs.where("doc_id < 40").select((F.col("doc_id") + 1000 * i).alias("doc_id"), "text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{copies}")
        before = shuffled_rows(spark)
        assert ppm.ppm_score(spark.read.parquet(f"{tmp_path}/{copies}")).count() == copies * docs.where("doc_id < 40").count()
        moved.append(shuffled_rows(spark) - before)
    assert moved[0] > 0 and moved[1] < 1.5 * moved[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_ppm_counts_by_parts(monkeypatch, texts, parts):
    """Counts that are flushed midway, in two blocks that lie mixed, against a dictionary; and their way back."""
    monkeypatch.setattr(ppm, "FLUSH", 3000)
    monkeypatch.setattr(ppm, "HELD", 4000)
    monkeypatch.setattr(ppm, "CHUNK", 500)
    some = [t[:300] for t in list(texts.values())[:50]] + ["", "\0", None]
    blocks, out = np.arange(len(some)) % 2, np.arange(len(some)) % 5 == 3
    batches = [pa.record_batch([pa.array(blocks[i : i + 9]), pa.array(out[i : i + 9]), pa.array(some[i : i + 9], pa.string())], ["block", "held_out", "text"]) for i in range(0, len(some), 9)]
    rows = pa.Table.from_batches(ppm._counts(iter(batches), 3, parts)).sort_by([("part", "ascending"), ("kind", "ascending")])
    assert rows.num_rows > 4 * parts
    known = pa.Table.from_batches(ppm._totals(iter(rows.to_batches(max_chunksize=5))))
    total = {(r["kind"], r["key"]): (r["total"], r["part"]) for r in known.to_pylist() if r["block"] is None}
    assert len(total) == sum(r["block"] is None for r in known.to_pylist())
    expected, own = Counter(), {}
    for block, held, text in zip(blocks, out, some, strict=True):
        for part in textkit.slices(pa.array([text], pa.string())):
            for kind, keys in ((ppm.WORD, part.words().view(np.int64)), (ppm.GRAM, ppm.grams(part, 3)[0])):
                for k in keys.tolist():
                    expected[kind, k] += not held
                    own.setdefault((int(block), kind), set()).add(k)
    assert {k: n for k, (n, _) in total.items()} == dict(expected)
    assert all(p == k % ppm.PRIME % parts for (_, k), (_, p) in total.items())
    value = {k: (n + 1) / 7 for k, (n, _) in total.items() if n or k[0] == ppm.GRAM}
    asked = [{"part": total[k][1], "kind": k[0], "key": k[1], "value": v, "block": None, "keys": None} for k, v in value.items()]
    asked += [r | {"value": None} for r in known.drop_columns(["total"]).to_pylist() if r["block"] is not None]
    asked.sort(key=lambda r: (r["part"], r["kind"], -1 if r["block"] is None else r["block"]))
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("value", pa.float64()), ("block", pa.int64()), ("keys", pa.binary())])
    got = {}
    for batch in ppm._valued(iter(pa.Table.from_pylist(asked, schema).to_batches(max_chunksize=11))):
        for r in batch.to_pylist():
            got.setdefault((r["block"], r["kind"]), {}).update(zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r["values"]).tolist(), strict=True))
    assert got == {(b, kind): {k: value[kind, k] for k in keys if (kind, k) in value} for (b, kind), keys in own.items()}


def test_ppm_costs_are_sums_by_text(texts):
    some = [t[:200] for t in list(texts.values())[:700]] + ["", "a"]
    for part in textkit.slices(pa.array(some)):
        made, offsets = ppm.grams(part, 5)
        keys = np.unique(made)[::2]
        table = keys, np.linspace(0.1, 2, len(keys))
        value = dict(zip(*(x.tolist() for x in table), strict=True))
        slow = [math.fsum(value.get(k, math.log10(257)) for k in made[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert ppm.costs(made, offsets, table) == pytest.approx(slow, rel=1e-12)
        assert ppm.costs(made, offsets, (keys[:0], table[1][:0])) == pytest.approx(np.diff(offsets) * math.log10(257), rel=1e-12)


# --- 2: embeddings ---


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 16)).astype(np.float32)
    near = np.concatenate([base[:40] + rng.normal(size=(40, 16)).astype(np.float32) * s for s in (0.01, 0.04, 0.05)])
    whole = np.concatenate([base, near, base[:5], base[:1].repeat(30, 0)])
    rows = [(int(i), v.tolist(), int(i) % 2) for i, v in enumerate(whole)]
    more = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0] * 8, 1), (1004, base[0].tolist(), None), (1005, [None] + [1.0] * 15, 1), (1006, [], 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame(rows + more, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    got = {r.vec_id: r for r in rabitq.near_vectors(df.union(df.limit(3)).withColumn("rep", F.lit("clash"))).collect()}
    assert len(got) == len(rows) + len(more)
    u = whole.astype(float) / np.sqrt((whole.astype(float) ** 2).sum(1, keepdims=True))
    link = (u @ u.T >= 0.98) & (np.arange(len(u))[:, None] % 2 == np.arange(len(u))[None] % 2)
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(u)))
    assert found <= link.sum() and found >= 0.9 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(len(u)))
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] for r in more)
    for i in range(len(u)):
        assert got[i].component_id <= i and got[i].kept == (got[i].component_id == i)


def test_chunks_of_a_large_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "CHUNK", 16)
    rng = np.random.default_rng(2)
    v = (rng.normal(size=12) + rng.normal(size=(90, 12)) * 0.001).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = rabitq.near_vectors(df).collect()
    assert {r.n_links for r in got} == {89} and {r.component_id for r in got} == {0}


def test_bounds_hold_and_settle_most_pairs():
    rng = np.random.default_rng(5)
    for dim in (16, 64, 100):
        v = rng.normal(size=(300, dim))
        v[150:] = v[:150] + rng.normal(size=(150, dim)) * np.linspace(0.01, 1.5, 150)[:, None]
        u = rabitq.unit(v)
        upper = rabitq.bounds(made := rabitq.codes(v, 6, 5), made, dim)
        assert (upper >= u @ u.T - 1e-4).mean() > 0.9995
        i, j = rabitq.near(made, np.zeros(300, int), 0, 0.98, dim, 6, 5)
        true = np.argwhere(np.triu(u @ u.T >= 0.98, 1))
        assert {tuple(x) for x in true.tolist()} <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(true)
        if dim >= 64:  # what is left to compute
            assert len(i) <= 0.02 * 300 * 299 / 2
    # an estimate without its error is unbiased: over many turns its mean is the inner product
    q = rabitq.unit(rng.normal(size=(1, 32)) + 1)[0]
    o = rabitq.unit(rng.normal(size=(1, 32)) + 1)[0]
    turns = [np.linalg.qr(rng.normal(size=(32, 32)))[0] for _ in range(4000)]
    found = [np.sign(o @ r) @ (q @ r) / np.abs(o @ r).sum() for r in turns]
    assert abs(np.mean(found) - o @ q) < 4 * np.std(found) / np.sqrt(len(found))


def test_vectors_of_any_label_in_double_precision(spark):
    rows = [(1, [1e300, 0.0], "a"), (2, [1e300, 1.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 1e-9], "b"), (4, [0.0, 1.0], "b"), (5, [1e-300, 0.0], "a"), (5, [1e-300, 0.0], "a"), (6, [1.0, 0.25], "a")]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in rabitq.near_vectors(got).collect())
    assert found == [(1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 0, 3), (4, 1, 3), (5, 2, 1), (6, 0, 6)]


def test_no_vectors(spark):
    assert rabitq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- 3, 5, 7: classifiers ---


def slow_rules(t):
    w = WORD.findall(t or "")
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, labels, texts):
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, again = slow_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert not (r.base_failed and r.kept)
    y = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, y[r.doc_id]) for r in got if r.doc_id in y and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)


def test_quality_rules_on_odd_rows(odd, empty, labels):
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == len(ODD)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert r.doc_id == i and (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_rules(t)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    carried = quality_rules.quality_rules(odd, labels.limit(0), carry=True)
    assert {"source", "copy", "text"} <= set(carried.columns) and carried.where("kept AND NOT base_failed").count() > 0


M64 = (1 << 64) - 1


def slow_mix(x, salt=0):
    x = (x + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def slow_hash(raw):
    return slow_mix(sum(int(textkit.TOKEN[b]) * pow(textkit.BASE, i, 1 << 64) for i, b in enumerate(raw)) + len(raw))


def slow_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", t.encode())


def slow_quality(t, model, bits):
    """The classifier by its definition: the mean weight of each family's n-grams, one after the other."""
    words, raw, z = slow_words(t), t.encode(), float(model["bias"][0])
    w = model["w"].reshape(quality_rules.FAMILIES, -1)
    hashes, folded = [slow_hash(x) for x in words], [x.lower() for x in words]
    pairs = [2] + [1 if folded[i] == folded[i - 1] else slow_mix((hashes[i - 1] * 3 & M64) ^ slow_mix(hashes[i], 2), 9) for i in range(1, len(words))]
    grams = lambda n: [int.from_bytes(raw[i : i + n], "big") * 2654435761 % (1 << 32) >> (32 - bits) for i in range(len(raw) - n + 1)]
    found = [[slow_mix(h, 1) >> (64 - bits) for h in hashes], [slow_mix(h, 4) >> (64 - bits) for h in pairs[: len(words)]], grams(3), grams(4)]
    for f, keys in enumerate(found):
        z += sum(float(w[f][k]) for k in keys) / max(1, len(keys))
    return 1 / (1 + math.exp(-z))


def test_quality_score_by_definition_in_any_batch(spark, docs, labels, texts):
    bits = quality_rules.BITS
    rules = lambda d: {r.doc_id: r.score for r in quality_rules.quality_rules(d, labels).collect()}
    model = quality_rules.fitted(quality_rules.sampled(docs, labels, "quality", quality_rules.SAMPLE), "quality", lambda t: quality_rules.sparse(t, bits), lambda *a: quality_rules.fit(*a, bits))
    assert rules(docs.repartition(1).sortWithinPartitions("doc_id")) == rules(docs.repartition(3).sortWithinPartitions(F.desc("doc_id")))
    got = rules(docs)
    for i, t in list(texts.items())[:60]:
        assert got[i] == pytest.approx(slow_quality(t or "", model, bits), abs=1e-9)


def test_linear_scores_by_definition(docs, labels, texts):
    bits = ftrl.BITS
    model = ftrl.fitted(ftrl.sampled(docs, labels, "quality", ftrl.SAMPLE, ~ppm.held_out(F.col("doc_id"), 5, 0)), "quality", lambda t: ftrl.sparse(t, bits), lambda *a: ftrl.ftrl(*a, bits))
    got = {r.doc_id: r.score for r in ftrl.ftrl_score(docs, labels).collect()}
    for i, t in list(texts.items())[:60]:
        words = slow_words(t or "")
        h = [slow_hash(x) for x in words]
        keys = [slow_mix(x, 3) for x in h] + [slow_mix(x[-1], 7) for x in words]
        keys += [slow_mix(1 if a.lower() == b.lower() else slow_mix(slow_mix(x, 1) + slow_mix(y, 2) & M64, 77), 5) for a, b, x, y in zip(words, words[1:], h, h[1:], strict=False)]
        z = sum(float(model["w"][k >> (64 - bits)]) for k in keys) / math.sqrt(max(1, len(words))) + float(model["bias"][0])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_factors_by_all_pairs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 5 = 0").collect()}
    model = toxicity.fitted(toxicity.sampled(docs, labels, "toxic", toxicity.SAMPLE, ~ppm.held_out(F.col("doc_id"), 3, 1)), "toxic", toxicity.sparse, toxicity.fit)
    got = {r.doc_id: r.score for r in toxicity.toxicity_score(docs, labels).collect()}
    place = {int(k) & M64: i for i, k in enumerate(model["keys"])}
    v, (slope, shift) = model["v"].reshape(len(place), -1), model["slope"]
    for i, t in list(texts.items())[:60]:
        found = set()
        for x in slow_words(t or ""):
            x = bytes(b + 32 if 65 <= b <= 90 else b for b in x)
            for _ in range(3):
                x = x[:-1] if len(x) > 1 and x[-1] in b".,;:!?)\"'" else x
            found |= {slow_mix(slow_hash(x), 1)} | {slow_mix(slow_hash(x[:n]), n) for n in (4, 5, 6) if len(x) > n}
        at = sorted(place[k] for k in found if k in place)
        z = float(model["bias"][0]) + sum(model["w"][a] for a in at) + sum(float(v[a] @ v[b]) for k, a in enumerate(at) for b in at[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-slope * z - shift)), abs=1e-9)


def test_a_repeated_labelled_id_is_sampled_once(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50} {'b' if i < 50 else 'a'}") for i in range(4000)] + [(60, "x" * 200_000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    got = {r.doc_id: r.text for r in ftrl.sampled(docs, labels, "quality", 100).collect()}
    assert got == {i: f"text {i} a" for i in range(50)}


def check_scores(rows, labels, label, modulus, remainder, least):
    y = {r.doc_id: r[label] for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1
    pairs = [(r.score, y[r.doc_id]) for r in rows if r.held_out and y.get(r.doc_id) is not None]
    pos, neg = ([s for s, v in pairs if v == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc >= least, auc


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    check_scores(ftrl.ftrl_score(docs, labels).collect(), labels, "quality", 5, 0, 0.9)
    check_scores(toxicity.toxicity_score(docs, labels).collect(), labels, "toxic", 3, 1, 0.7)


def test_classifiers_on_odd_rows(odd, empty, labels):
    none = labels.limit(0)
    for f in (lambda d, x: ftrl.ftrl_score(d, x), lambda d, x: toxicity.toxicity_score(d, x)):
        for marks in (labels, none, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(None).cast("int")})):
            got = f(odd, marks).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
            assert {r.held_out for r in got if r.doc_id is None} == {False}
        assert f(empty, labels).count() == 0


def test_factors_learn_an_interaction():
    """The label is an exclusive-or of two terms, neither of which says anything alone: no sum of weights separates it."""
    rng = np.random.default_rng(3)
    index, offsets, y = [], [0], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        index += ([5] if a else []) + ([9] if b else []) + [int(x) for x in set(rng.integers(100, 400, 6).tolist())]
        offsets.append(len(index))
        y.append(int(a != b))
    y = np.array(y)
    m = toxicity.fit(np.array(index), None, np.array(offsets), y, np.ones(len(y)))
    v = m["v"].reshape(len(m["keys"]), -1)
    place = {k: i for i, k in enumerate(m["keys"])}
    z = lambda *ks: toxicity.machine(np.zeros(len(ks), int), np.array([place[k] for k in ks], int), 1, m["bias"][0], m["w"], v)[0][0]
    slope, shift = m["slope"]
    assert min(z(5), z(9)) * slope + shift > 2 and max(z(5, 9), z()) * slope + shift < -2


# --- 4: pieces ---


@pytest.fixture(scope="module")
def piece_machine():
    with open(spm.default_model(), "rb") as f:
        return spm.Machine(f.read())


def test_pieces_equal_the_library(piece_machine, texts):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    rnd = random.Random(5)
    alphabet = "aabcdef  \n\t▁éß梦☃,.0123456789\x00ABtheing'’“”—"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for t in [*texts.values(), *made, "  lead", "a    b", "x" * 300, LONG[:3000]]:
        assert np.frombuffer(piece_machine.encode(t), np.int32).tolist() == library.encode(t)


def test_a_character_map_equals_the_library(texts):
    import sentencepiece

    with open(spm.default_model(), "rb") as f:
        model = f.read() + sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=model), spm.Machine(model)
    assert len(mine.rules) > 1000
    odd = ["ＡＢＣ　①  ｶﾞ", "ﬁne Å \u1e9b\u0323 \u0344", "a\u200bb\tc\r\nd", "½ ™ 𝔘𝔫𝔦 ㌀", "한글 가", "", "  ", "e\u0301\u0327 o\u0308", "\ufeffx\u00ad\u2028y"]
    for t in [*odd, *list(texts.values())[:60]]:
        assert np.frombuffer(mine.encode(t or ""), np.int32).tolist() == library.encode(t or ""), t


def test_unigram_shortest_path():
    """A model of three pieces: the cheapest path wins over the longest piece."""

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        import struct

        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + piece("▁", -1) + piece("ab", -5) + piece("a", -1) + piece("b", -1) + piece("▁a", -1.5) + field(2, bytes([3 << 3, 1])) + field(3, b"")
    m = spm.Machine(model)
    assert m.path("▁ab") == ["▁a", "b"]
    assert [m.text[i] for i in np.frombuffer(m.encode("a?b"), np.int32)] == ["▁a", "<unk>", "b"]


def test_pieces_on_odd_rows(odd, empty):
    got = spm.encoded(odd).collect()
    assert len(got) == len(ODD) and all(r.decoded == (r.text or "") and r.round_trip for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert spm.report(empty).count() == 0


# --- 6: set join ---


def slow_links(texts, width, num, den):
    sets = {}
    for i, t in texts.items():
        w = [lower(x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = list(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and k * den >= num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_set_join_finds_every_link(spark, width, num, den):
    """Families of near copies with edits up to and beyond the threshold, of short and long sets."""
    rng = np.random.default_rng(7)
    rows = {}
    for size in (1, 2, 3, 4, 6, 9, 14, 25, 40, 90, 200, 450):
        for _ in range(3):
            base = [f"w{x}" for x in rng.integers(0, 100_000, size)]
            for edits in (0, 0, 1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(min(edits, max(1, size // 12))):
                    at = int(rng.integers(0, len(w)))
                    w[at : at + 1] = [f"n{rng.integers(0, 10**9)}"] * int(rng.integers(0, 3))
                rows[len(rows)] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(df, width, num, den).collect()}
    assert got == slow_links(rows, width, num, den)


def test_set_join_on_odd_rows(odd, empty):
    got = partenum.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[2][1] == 1 and by[10][1] == 9 and by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[None][1] is None
    assert partenum.jaccard_components(empty).count() == 0


# --- 8: sharding ---


def test_flow_moves_fewest_bytes():
    flow = reshard.min_cost_flow([10, 0, 2], [4, 4, 4], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert flow[0] == [4, 4, 2] and flow[2] == [0, 0, 2]
    assert reshard.min_cost_flow([6, 0], [3, 3], [[0, 5], [5, 0]]) == [[3, 3], [0, 0]]
    far = reshard.min_cost_flow([4, 4, 0], [2, 2, 4], [[0, 9, 3], [9, 0, 4], [3, 4, 0]])
    assert sum(c * f for a, b in zip([[0, 9, 3], [9, 0, 4], [3, 4, 0]], far, strict=True) for c, f in zip(a, b, strict=True)) == 14
    with pytest.raises(ValueError, match="too small"):
        reshard.min_cost_flow([5], [4], [[0]])


def test_shards(docs, texts):
    placed, plan = reshard.resharded(docs)
    got = placed.collect()
    assert len(got) == len(texts)
    size = Counter()
    for s in range(16):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        size[s] = sum(r["size"] for r in mine)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in got)
    moved = sum(r["size"] for r in got if r.old_shard != r.shard)
    least = sum(sum(f) for f in plan.flow) - sum(plan.flow[i][i] for i in range(12))
    assert moved <= least + 16 * max(r["size"] for r in got)


def test_balanced_shards_stay(docs):
    placed, _ = reshard.resharded(docs)
    again, plan = reshard.resharded(docs.join(placed.select("doc_id", "shard"), "doc_id"), old_shard=F.col("shard"), old=16)
    assert again.where("old_shard <> shard").count() <= 16
    assert len(plan.touched) <= 16


def test_only_touched_shards_are_written(spark, docs, tmp_path):
    rows = docs.withColumn("old", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).cast("int"))
    sizes = [r.s for r in rows.groupBy("old").agg(F.sum(F.octet_length("text") + 1).alias("s")).orderBy("old").collect()]
    plan = reshard.rewritten(rows, str(tmp_path / "out"), F.col("old"), 2, shards=3, capacity=[sizes[0], sizes[1] - sizes[1] // 4, sizes[1] // 4 + 100_000])
    assert plan.touched == {1, 2}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard for r in out.select("shard").distinct().collect()} == {1, 2} and "lang" in out.columns


def test_shards_on_odd_rows(odd, empty):
    got = reshard.resharded(odd)[0].collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id in (3, 4)} == {1}
    assert reshard.resharded(empty)[0].count() == 0


# --- 9: mixing ---


def test_counts_follow_the_poisson_quantile(spark, docs):
    got = mixing.counted(docs, alpha=0.5).collect()
    for r in got:
        import hashlib

        u = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        k, p, total = 0, math.exp(-r.rate), math.exp(-r.rate)
        while u >= total:
            k += 1
            p *= r.rate / k
            total += p
        assert r.n_copies == k
    size = sum(len((r.text or "").encode()) + 1 for r in got)
    share = sum((len((r.text or "").encode()) + 1) * r.rate for r in got)
    assert share == pytest.approx(size, rel=1e-9)


def test_mean_and_order(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.when(F.col("id") % 4 == 0, "s").alias("source"))
    got = mixing.replicated(rows, {"s": 3.0, None: 1.0}, epochs=2.0)
    by = {r.source: r.n / k for r, k in ((r, 5000 if r.source else 15000) for r in got.groupBy("source").agg(F.count("*").alias("n")).collect())}
    assert by["s"] == pytest.approx(6.0, rel=0.05) and by[None] == pytest.approx(2 / 3, rel=0.05)
    assert got.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_mixing_on_odd_rows(odd, empty):
    assert mixing.counted(odd).count() == len(ODD)
    assert mixing.replicated(odd).where("copy < 1 OR copy > n_copies").count() == 0
    assert mixing.replicated(empty).count() == 0
    assert mixing.replicated(odd, {"nowhere": 1.0}).count() == 0


# --- 10: chunks ---


def slow_chunks(raw):
    """Chunks as pairs of first and last word by the definition, word after word; for texts without long words."""
    ends = [m.end() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    hashes, h = [], 0
    for b in raw:
        h = (2 * h + int(cdc.GEAR[b])) % 65536
        hashes.append(h)
    at = [hashes[e - 1] if e >= 16 else 1 << 16 for e in ends]
    cuts = {len(ends) - 1}
    for i in range(len(ends) - cdc.WINDOW + 1):
        inside = range(i, i + cdc.WINDOW)
        cuts.add(max(k for k in inside if at[k] == min(at[j] for j in inside)))
    cuts = sorted(cuts)
    return list(zip([0, *(c + 1 for c in cuts[:-1])], cuts, strict=True)) if ends else []


def test_chunks_by_definition(texts):
    found = [t for t in texts.values() if len(t) < 4000 and max(map(len, WORD.findall(t)), default=0) <= 10][:80] + ["", "é" * 10, "a b " * 100, " \n"]
    for part in textkit.slices(pa.array(found), 20_000):
        every = cdc.units(part)
        first, last = cdc.chunks(part, every)
        for i in range(len(part)):
            mine = every.doc[first] == i
            base = every.offsets[i]
            assert [(int(a - base), int(b - base)) for a, b in zip(first[mine], last[mine], strict=True)] == slow_chunks(found[part.first + i].encode())


def test_chunks_resist_insertions(texts):
    a, b = list(texts.values())[:2]

    def cut(t):
        part = next(textkit.slices(pa.array([t])))
        every = cdc.units(part)
        return {t.encode()[every.start[i] : every.end[j]] for i, j in zip(*cdc.chunks(part, every), strict=True)}

    whole, moved = cut(a + b), cut("put in front " + a + b)
    assert len(whole & moved) >= len(whole) - 3


def test_texts_of_one_id_are_texts_of_their_own(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghi\u0430\u0431\u0432"), rng.integers(2, 9))) for _ in range(n))
    passage, other = prose(70), prose(90)
    rows = [(1, f"{prose(30)} {passage} {prose(30)}"), (2, f"{prose(55)} {passage} {prose(20)}"), (2, other), (2, other), (3, "abc"), (2, None), (4, prose(200) + "\u0430")]
    got = cdc.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    gone = [r.n_repeated for r in got]
    assert sum(gone) == 1 and next(r for r in got if r.n_repeated).text_bytes == len(rows[1][1].encode())
    assert sorted(r.text for r in got if not r.n_repeated) == sorted(t or "" for i, t in rows if t != rows[1][1])


def test_a_passage_of_many_texts_goes_from_all_but_one(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))
    passages, line = [prose(52 + i) for i in range(20)], prose(30)
    rows = [(i, f"{prose(10 + i % 50)} {passages[i % 20]} {prose(17)} {line}") for i in range(600)]
    rows += [(600 + i, f"{prose(60)} {line} {prose(33)}") for i in range(100)]
    got = {r.doc_id: r for r in cdc.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if 20 <= i < 600:  # a word beside the passage may be the same by chance
            assert passages[i % 20] not in got[i].text and 0 <= len(t) - len(got[i].text) - len(passages[i % 20]) <= 8
        else:
            assert got[i].text == t


def test_repeated_passages_go_once(spark, texts):
    own = [t for t in texts.values() if len(WORD.findall(t)) >= 150][:12]
    clean = [" ".join(f"{w}{i}{k}" for k, w in enumerate(WORD.findall(t)[:120])) for i, t in enumerate(own)]
    passage = " ".join(f"shared{k * k}" for k in range(60))
    rows = [(i, f"{t[:300]} {passage} {t[300:]}" if i % 3 == 0 else t) for i, t in enumerate(clean)]
    rows += [(100, clean[1]), (101, clean[1])]
    got = {r.doc_id: r for r in cdc.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts_ = dict(rows)
    for i, t in texts_.items():
        gone = sum(s.end - s.start for s in got[i].removed)
        assert len(got[i].text.encode()) + gone == len(t.encode()) == got[i].text_bytes
        if i in (100, 101):
            assert got[i].text == ""
        elif i % 3 == 0 and i:
            assert gone >= 0.5 * len(passage), (i, gone)
        else:
            assert gone == 0 and got[i].text == t


def test_chunks_on_odd_rows(odd, empty):
    got = cdc.deduplicated(odd)
    assert set(odd.columns) <= set(got.columns) | {"spans"} and got.count() == len(ODD)
    by = {r.doc_id: r for r in got.collect()}
    assert by[None].text == "no id here" and by[3].text == "" and by[7].n_repeated > 0
    assert cdc.deduplicated(empty).count() == 0


def test_passages_of_51_short_words_go_whole(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrst"), n))
    prose = lambda n, most: " ".join(word(rng.integers(1, most + 1)) for _ in range(n))
    rows, shared = [], []
    for i in range(150):
        shared.append(prose(51, 4))
        rows += [(2 * i + k, f"{prose(60 + i % 7 + 9 * k, 9)} {shared[i]} {prose(40, 9)}") for k in (0, 1)]
    got = {r.doc_id: r for r in cdc.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i, p in enumerate(shared) if p in got[2 * i + 1].text or not got[2 * i + 1].n_repeated]
    assert missed == [] and all(got[2 * i].text == rows[2 * i][1] for i in range(150))
    for i in range(150):
        front, back = rows[2 * i + 1][1].split(shared[i])
        assert got[2 * i + 1].text.split() == (front + back).split()


def test_passages_without_spaces_go_wherever_they_stand(spark):
    rng = np.random.default_rng(4)
    kinds = [lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n // 3))), lambda n: "".join(rng.choice(list("abcdefABCDEF0123456789+/"), n)), lambda n: "\u00a0".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n // 7))]
    rows, shared = [], []
    for i in range(90):
        make = kinds[i % 3]
        shared.append(make(1200))
        rows += [(2 * i + k, make(400 + 5 * i + 111 * k) + shared[i] + make(350)) for k in (0, 1)]
    got = {r.doc_id: r for r in cdc.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(90):
        assert sum(s.end - s.start for s in got[2 * i + 1].removed) >= 1100, i
        assert got[2 * i].text == rows[2 * i][1]
    lines = [(i, f"{i} first{i * i}\n{'=' * 100}\nlast{i * 7}") for i in range(20)]
    assert all(r.removed == [] for r in cdc.deduplicated(spark.createDataFrame(lines, "doc_id long, text string")).collect())


def test_rewritten_shards_keep_every_row(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(None if i % 5 == 0 else i // 2 * 2, f"text {i // 2} ", f"note {i}", i % 3) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, note string, shard int").write.partitionBy("shard").parquet(path)
    size = {s: sum(len(r[1]) + 1 for r in rows if r[3] == s) for s in range(3)}

    def read():
        return spark.read.option("mergeSchema", True).parquet(path)

    def files(shard):
        return {f.name: f.read_bytes() for f in (tmp_path / "out" / f"shard={shard}").glob("*.parquet")}

    whole, still = sorted(map(repr, (r[:3] for r in rows))), files(0)
    plan = reshard.rewritten(read(), path, F.col("shard"), 3, shards=4, capacity=[size[0], size[1], size[2] - size[2] // 2, size[2] // 2])
    got = read().collect()
    assert plan.touched == {2, 3} and files(0) == still
    assert sorted(repr((r.doc_id, r.text, r.note)) for r in got) == whole
    for s in plan.touched:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # fewer shards than before: the last one's files go
    plan = reshard.rewritten(read(), path, F.col("shard"), 4, shards=3, capacity=[size[0], size[1], size[2] + 100])
    got = read().collect()
    assert 3 in plan.touched and {r.shard for r in got} == {0, 1, 2}
    assert sorted(repr((r.doc_id, r.text, r.note)) for r in got) == whole

"""Pinned cases of the text, evidence, routing, exchange, batch and tag rules, with nulls, blanks, ties and empty tables."""

import json
import math
import time

import pytest
from pyspark.sql import functions as F

from lodestone import store
from lodestone.functions import text
from lodestone.operators import attempts, audits, batches, delta, evaluation, evidence, exchange, retrieval, routing, tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def words(*found):
    return F.array(*map(F.lit, found)).cast("array<string>")


def test_han_characters_words_and_decimals_are_tokens(spark):
    assert one(spark, text.tokens(F.lit("心肌梗死 ABC 3.5mg 12. x-Y é"))) == ["心", "肌", "梗", "死", "abc", "3.5", "mg", "12", "x", "y"]
    assert one(spark, text.query_terms(F.lit("下列关于心肌的是 A B 梗死 的 心"))) == ["下", "列", "关", "心", "肌", "梗", "死"]
    assert one(spark, text.tokens(F.lit(""))) == []


def test_chinese_questions_find_their_chunk(spark):
    chunks = spark.createDataFrame([("1", "胃溃疡的治疗"), ("2", "心肌梗死胸痛"), ("3", "骨折"), ("4", None), ("5", "")], "chunk_id string, chunk_text string")
    index = retrieval.indexed(chunks.where("chunk_text IS NOT NULL"))
    asked = retrieval.asked(spark.createDataFrame([(1, "心肌梗死的胸痛"), (2, "的"), (3, None)], "query_id long, text string"))
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.best(index, asked, 3).collect()]
    assert got == [(1, "2", 1)]
    none = retrieval.indexed(chunks.limit(0))
    assert retrieval.best(none, asked, 3).count() == 0 and retrieval.best(index, asked.limit(0), 3).count() == 0


def test_equal_scores_are_ranked_by_chunk(spark):
    chunks = spark.createDataFrame([(str(i), "alpha beta" if i < 6 else "gamma delta") for i in range(40)], "chunk_id string, chunk_text string").repartition(5)
    asked = retrieval.asked(spark.createDataFrame([(1, "alpha"), (1, "alpha")], "query_id long, text string"))
    assert [r.chunk_id for r in retrieval.best(retrieval.indexed(chunks), asked, 4).orderBy("rank").collect()] == ["0", "1", "2", "3"]


@pytest.mark.parametrize("by", [None, "book"])
def test_a_search_in_small_blocks_hands_on_few_rows_and_finds_the_same(spark, monkeypatch, by):
    """Tasks give at most k rows a query and group, whatever they hit; rows are handed on early and queries dealt into passes."""
    texts = [(None if i == 7 else f"{i:04d}", " ".join(f"w{chr(97 + x)}" for x in (i % 5, i % 7, i % 11, i * i % 13)), None if i % 4 == 3 else f"b{i % 4}") for i in range(600)]
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_text string, book string").repartition(3).persist()
    index = retrieval.indexed(chunks, ("book",))
    asked = retrieval.asked(spark.createDataFrame([(i, f"w{chr(97 + i)} w{chr(98 + i)} wa wa") for i in range(12)], "query_id int, text string"), variant=retrieval.OKAPI).persist()
    given = retrieval.searched(index, asked, 3, retrieval.OKAPI, by)
    assert given.count() <= 3 * 12 * 3 * (4 if by else 1)
    df, mean = {}, sum(len(t.split()) for _, t, _ in texts) / len(texts)
    for _, t, _ in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    usual = sum(idf.values()) / len(idf) / 4
    hits = {}
    for q, term, times in asked.collect():
        for name, t, book in texts:
            tf, length = t.split().count(term), len(t.split())
            if tf:
                at = (q, name, book)
                hits[at] = hits.get(at, 0) + (usual if idf[term] < 0 else idf[term]) * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
    groups = {}
    for (q, name, book), x in hits.items():
        groups.setdefault((q, book if by else ""), []).append((-round(x, 6), name or "", q))
    expected = sorted((q, name, -x) for found in groups.values() for x, name, q in sorted(found)[:3])
    for small in ({}, {"CELLS": 60, "SUMS": 7, "ROWS": 5, "TERMS": 9}):
        for k, v in small.items():
            monkeypatch.setattr(retrieval, k, v)
        got = sorted((r.query_id, r.chunk_id or "", r.score) for r in retrieval.best(index, asked, 3, retrieval.OKAPI, by).collect())
        assert [x[:2] for x in got] == [x[:2] for x in expected] and [x[2] for x in got] == pytest.approx([x[2] for x in expected], abs=2e-6)


def test_the_pairs_of_a_long_text_take_linear_time(spark):
    began = time.time()
    assert one(spark, F.size(text.bigrams(F.repeat(F.lit("Straße, 12 心肌 "), 8_000)))) == 11
    assert time.time() - began < 20
    assert one(spark, text.bigrams(F.lit("aß, b"))) == ["as", "ss", "sb"] and one(spark, text.bigrams(F.lit("a."))) == []


def score(spark, sentence, answers, stem):
    row = evidence.asked(spark.createDataFrame([(answers, stem, sentence)], "answers array<string>, stem string, s string"))
    return row.select(evidence.support(F.col("s"), F.col("answers"), F.col("_units"), F.col("_terms"), F.col("_asks"))).first()[0]


def test_support_of_a_sentence(spark):
    assert score(spark, "", ["x"], "y") == 0
    assert score(spark, "胸痛是主要表现。", ["胸痛"], "患者，发热") == 210
    assert score(spark, "胸闷", ["胸痛"], "") == 0
    assert score(spark, "Fever and cough", ["fever"], "cough cough x") == pytest.approx(90 + 5 + 5)
    assert score(spark, "生理学研究机体的功能", [], "生理学是研究什么") == 18
    assert score(spark, "目录 第一章", [], "") == -12
    assert score(spark, "目录 胸痛", ["胸痛"], "") == 210


def test_excerpts_keep_a_proposal_that_stands_in_the_quote(spark):
    quote = "绪论。  胸痛是\n心肌梗死的主要表现。发热少见。"
    rows = [(quote, ["胸痛"], "表现", "A.胸痛 心肌梗死", None, None), (quote, ["无关"], "无", "x", "发热少见。", ["发热", "编造"]), (quote, ["胸痛"], "表现", "x", "编造的话", None), (None, ["a"], "b", "c", None, None), ("", None, None, None, "", None)]
    df = spark.createDataFrame(rows, "quote string, answers array<string>, stem string, question string, model_excerpt string, model_highlights array<string>")
    got = evidence.excerpts(df.withColumn("answers", F.coalesce("answers", words())).withColumn("stem", F.coalesce("stem", F.lit("")))).collect()
    assert [r.excerpt for r in got] == ["胸痛是 心肌梗死的主要表现。", "发热少见。", "胸痛是 心肌梗死的主要表现。", "", ""]
    assert got[0].highlights == ["胸痛", "心肌梗死"] and got[1].highlights == ["发热"]
    assert got[0].context == "绪论。胸痛是 心肌梗死的主要表现。发热少见。" and got[3].context == ""


def test_context_leaves_out_lines_that_say_nothing(spark):
    df = spark.createDataFrame([("第三章\n12\n| 要点\n本章数字资源 3", ["x"], "s", "q")], "quote string, answers array<string>, stem string, question string")
    assert evidence.excerpts(df).first().context == "要点"


def test_proposed_contexts_must_be_grounded(spark):
    quote = "the dose of 5 mg is given twice a day to adults"
    ask = lambda p: one(spark, evidence.grounded_context(F.lit(p), F.lit(quote), F.lit("local")))
    assert ask("the dose of 5 mg is given twice") == "the dose of 5 mg is given twice"
    assert ask("the dose of 7 mg is given twice") == "local" and ask("short") == "local" and ask(None) == "local"


def test_clues_and_search_texts(spark):
    stem = "患者男，发热3天。血常规升高！既往高血压；问？"
    found = one(spark, routing.case_clues(F.lit(stem), F.lit(None).cast("string")))
    assert [(c.label, c.text) for c in found] == [("检验影像", "血常规升高"), ("病程体征", "患者男，发热3天"), ("既往用药", "既往高血压")]
    assert one(spark, routing.case_clues(F.lit(""))) == []
    clues = routing.case_clues(F.lit(stem))
    texts = lambda kind: [x.text for x in one(spark, routing.search_texts(F.lit(kind).cast("string"), F.lit("题干"), F.lit("p"), F.lit("B"), words("A.甲", "B.乙", "C乙"), clues))]
    assert texts("A1") == ["题干 B.乙"]
    assert texts("A2") == texts(None) == ["题干 B.乙", "血常规升高 B.乙", "患者男，发热3天 B.乙"]


def test_libraries_beside_a_subject(spark):
    libs = spark.createDataFrame([(1, "外科"), (2, "诊断学"), (3, "药理学"), (4, None), (5, "解剖学")], "library_id long, subject string")
    asked = spark.createDataFrame([(1, "外基"), (2, "未知"), (3, None)], "query_id long, subject string")
    got = {(r.query_id, r.library_id): r.role for r in routing.routed(asked, libs).collect()}
    assert got == {(1, 1): "primary", (1, 2): "secondary", (1, 5): "secondary"}
    all_ = {(r.query_id, r.library_id): r.role for r in routing.routed(asked, libs, chosen=True).collect()}
    assert all_[1, 3] == "secondary" and (2, 1) in all_ and all_[1, 1] == "primary"
    assert routing.routed(asked, libs.limit(0)).count() == 0
    held = spark.createDataFrame([(1, None, None), (2, "ready", 0), (3, "error", 1), (4, "warning", 2)], "library_id long, file_status string, file_count int")
    assert {r.library_id for r in routing.usable(held).collect()} == {1, 4}


def test_envelopes_are_dealt_and_told_apart(spark):
    rows = spark.createDataFrame([(i, "school" if i % 2 else None, f"q{i}") for i in range(100)], "id long, bank string, question string")
    made = exchange.envelopes(rows, "s", "", "test", "now", most=20).collect()
    found = sorted(q["id"] for r in made for q in json.loads(r.document)["questions"])
    assert found == list(range(100)) and {json.loads(r.document)["schemaVersion"] for r in made} == {2} and len(made) > 2
    assert all(json.loads(r.document)["meta"]["questionCount"] == r.n_questions for r in made)
    assert exchange.envelopes(rows.limit(0), "s", "", "t", "n").count() == 0
    good = [one(spark, exchange.is_envelope(F.lit(x), "s")) for x in (made[0].document, '{"schema":"s","schemaVersion":1,"questions":[]}', "[]", "no", '{"schema":"s","schemaVersion":2,"questions":{}}')]
    assert good == [True, False, False, False, False]


def test_patches_carry_what_was_there(spark):
    base = spark.createDataFrame([(1, "c", "old", None), (2, "c", "n", "t"), (3, "c", "n", "t"), (5, "c", "n", "t")], "id long, core string, note string, tag string")
    now = spark.createDataFrame([(1, "c", "new", "t", []), (2, "c", "n", "t", []), (3, "x", "n", "t", []), (4, "c", "n", "t", []), (5, "c", "z", "t", ["bad"])], "id long, core string, note string, tag string, errors array<string>")
    found = delta.preflight(now, base, "id", ["core"], ["note", "tag"])
    sent = exchange.patched(now.drop("errors").withColumn("extensions", F.create_map(F.lit("patch"), F.lit("stale"), F.lit("own"), F.lit("1"))), found, "id").collect()
    assert [r.id for r in sent] == [1] and sent[0].extensions["own"] == "1"
    assert json.loads(sent[0].extensions["patch"]) == {"version": 1, "fields": ["note", "tag"], "baseValues": {"note": "old", "tag": None}} or json.loads(sent[0].extensions["patch"])["baseValues"]["note"] == "old"
    report = exchange.delta_report(found, 7).first()
    assert (report.ready, report.unchanged, report.pending, report.issues) == (1, 1, 7, 3)
    assert report.reasons == {"invalid": 1, "core changed": 1, "no baseline": 1}


def test_batches_are_judged_mended_and_put_in(spark):
    kind = "ordinal long, source string, number long, bank string, id string, core string, content string, answer string, errors array<string>"
    items = [(0, "f", 1, "school", "1", "k1", "x", "A", None), (1, "f", 2, "school", "1", "k1", "x", "A", None), (2, "f", 3, None, "2", "k2", "y", "A", []), (3, "f", 4, "kaoyan", "3", "k3", "z", "A", ["no stem"]), (4, "g", 1, "school", "9", "k9", "q", "B", []), (5, "g", 2, "kaoyan", "7", "k7", "w", "A", [])]
    old = spark.createDataFrame([("school", "9", "k9", "q", "A"), ("kaoyan", "7", "k0", "other", "A")], "bank string, id string, core string, content string, answer string")
    draft = batches.preview(spark.createDataFrame(items, kind), old, "d")
    got = {r.ordinal: (r.status, r.reason) for r in draft.collect()}
    assert got[0][0] == "ready" and got[1][0] == "duplicate" and got[2] == ("issue", "no bank") and got[3] == ("issue", "no stem")
    assert got[4][0] == "duplicate" and got[5] == ("issue", "content conflict")
    fixed = spark.createDataFrame([(2, "school", "2", "k2", "y", "A", [])], "ordinal long, bank string, id string, core string, content string, answer string, errors array<string>")
    again = batches.resume(draft, fixed, old, "d")
    assert tuple(batches.summary(again).first()) == ("d", 6, 2, 2, 2)
    sets, rows = batches.committed(again, "import")
    assert [(r.name, r.question_count) for r in sets.collect()] == [("import · school", 2)] and sorted(r.external_id for r in rows.collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="only issues"):
        batches.resume(draft, fixed.withColumn("ordinal", F.lit(0).cast("long")), old, "d")
    assert batches.summary(batches.preview(spark.createDataFrame([], kind), old, "d")).count() == 0


def test_questions_without_tags_stay(spark):
    rows = spark.createDataFrame([("s", "x", 1, ["A"], []), ("s", "x", 2, [], []), ("s", "x", 3, None, None), (None, None, 4, None, ["A"]), ("s", "x", None, ["B"], None)], "set_id string, subject string, question_id long, tags array<string>, suggested array<string>")
    _, made = tags.synced(rows)
    got = sorted((r.question_id or 0, r.tags, r.suggested) for r in made.collect())
    assert [x[0] for x in got] == [0, 1, 2, 3, 4] and got[1] == (1, [], ["A"]) and got[2][1:] == got[3][1:] == ([], [])
    assert tags.synced(rows.limit(0))[1].count() == 0


def test_tags_become_active_by_use(spark):
    rows = spark.createDataFrame([("s", "x", 1, ["A", "B"], ["c c", "D"])], "set_id string, subject string, question_id long, tags array<string>, suggested array<string>")
    got = tags.renamed(rows, "cc", "  New   name ", True, 3).first()
    assert (got.tags, got.suggested) == (["A", "B", "New name"], ["D"])
    for bad in (lambda: tags.renamed(rows, "A", " x "), lambda: tags.renamed(rows, "A", "ok", True, 2)):
        with pytest.raises(ValueError):
            bad()
    merged = tags.merged(rows, ["A", "c c"], "B").first()
    assert (merged.tags, merged.suggested) == (["B"], ["D"])
    catalog = spark.createDataFrame([("s", "x", "a", "active", 3), ("s", "x", "b", "candidate", 1), ("s", "y", "c", "active", 4)], "set_id string, subject string, key string, status string, usage int")
    assert [(r.source, r.target) for r in tags.merge_targets(catalog).collect()] == [("b", "a")]
    after = {r.key: (r.status, r.usage, r.merged_into) for r in tags.merged_catalog(catalog, "b", "a").collect()}
    assert after["b"] == ("merged", 0, "a") and after["a"] == ("active", 3, "")


def test_pieces_hold_whole_lines(spark):
    texts = spark.createDataFrame([(1, "a" * 5 + "\n" + "b" * 3 + "\n" + "c" * 25), (2, ""), (3, "\n\n"), (4, "x" * 10)], "id long, text string")
    got = {}
    for r in audits.by_lines(texts, 10).orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.piece)
    assert got == {1: ["a" * 5 + "\n" + "b" * 3 + "\n", "c" * 10, "c" * 10, "c" * 5 + "\n"], 2: ["\n"], 3: ["\n\n\n"], 4: ["x" * 10, "\n"]}


def test_nearest_of_all_vectors(spark):
    v = [(i, [float(i), 1.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, [1.0, 2.0, 3.0]), (42, [29.0, 1.0])]
    rows = spark.createDataFrame(v, "vec_id long, vector array<double>")
    q = rows.where("vec_id IN (29, 0)").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in evaluation.nearest(q, rows, 3).orderBy("query_id", F.desc("cosine"), "vec_id").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {29: [42, 28, 27], 0: [1, 2, 3]}
    assert evaluation.nearest(q.limit(0), rows, 3).count() == 0


@pytest.mark.parametrize("cells", [1, 70, 500_000])
def test_nearest_in_slices_has_all_ties_in_order(spark, monkeypatch, cells):
    monkeypatch.setattr(evaluation, "CELLS", cells)
    v = {i: [float(i % 5), float(i % 3) - 1.0, 1.0] for i in range(120)}
    rows = spark.createDataFrame([*v.items()], "vec_id long, vector array<double>")
    got = {}
    for r in evaluation.nearest(rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), rows, 4).orderBy("query_id", F.desc("cosine"), "vec_id").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = lambda x: [y / math.sqrt(sum(z * z for z in x)) for y in x]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(unit(v[a]), unit(v[b]))), 6)
    assert got == {a: sorted((b for b in v if b != a), key=lambda b: (-cosine(a, b), b))[:4] for a in range(0, 120, 10)}


def test_answers_are_made_of_a_batch_and_rows_pass_as_they_are(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else i, [i]) for i in range(50)], "id int, n int, l array<int>").coalesce(1)
    call = lambda some: [f"{len(some)} {r['n']} {[*r['l']]}" for r in some]
    found = attempts.asked(rows, call, "x", "string", 20)
    assert [c for c in found.columns] == ["id", "n", "l", "x"]
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(i, None if i % 2 else i, [i], f"{20 if i < 40 else 10} {None if i % 2 else i} [{i}]") for i in range(50)]
    assert attempts.asked(rows.limit(0), call, "x", "string").count() == 0


def test_rows_are_dealt_into_parts_of_bounded_size(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert store.dealt(rows, "k", most=50).rdd.getNumPartitions() == 21
    assert store.dealt(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

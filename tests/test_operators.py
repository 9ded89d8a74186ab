import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.operators import browse, chunking, delta, evaluation, models, pages, questions, retrieval, status, tags
from lodestone.sources import readers, writers
from lodestone.streaming.index import index_stream, job_activity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("scores", "threshold", "level"),
    [([0.748], 0.6, "strong"), ([0.66, 0.65], 0.6, "strong"), ([0.62, 0.51], 0.6, "standard"), ([0.59, 0.58], 0.6, "low"), ([], 0.6, "low")],
)
def test_match_confidence(spark, scores, threshold, level):
    assert one(spark, scoring.match_confidence(F.array(*map(F.lit, scores)).cast("array<double>"), threshold)) == level


@pytest.mark.parametrize(("score", "sure", "grade"), [(0.75, "strong", "A"), (0.60, "standard", "B"), (0.49, "low", "C")])
def test_grades(spark, score, sure, grade):
    assert one(spark, scoring.evidence_grade(F.lit(sure), F.lit(score), 0.5, F.lit(2), F.lit(5))) == grade


def test_hybrid_score(spark):
    assert one(spark, scoring.hybrid_score(F.lit(0.6), F.lit(0.8), 0.25)) == pytest.approx(0.8)


def test_cosine_of_nothing_is_zero(spark):
    assert one(spark, scoring.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0


def test_windows_cover_the_text(spark):
    long = "x" * 1200
    rows = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "   "), (5, "y" * 500)], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_index): len(r.chunk_text) for r in chunking.windows(rows).collect()}
    assert got == {(1, 0): 500, (1, 1): 500, (1, 2): 300, (5, 0): 500}


def test_blocks_follow_headings(spark):
    rows = spark.createDataFrame([(1, "# T\na\nb\n\n| x |\n| y |\n## U\n$$z$$\n$$w$$")], "doc_id long, text string")
    got = [(r.kind, r.title, r.text) for r in chunking.blocks(rows).orderBy("block").collect()]
    assert got == [("paragraph", "T", "a\nb"), ("table", "T", "| x |\n| y |"), ("formula", "U", "$$z$$"), ("formula", "U", "$$w$$")]


def test_synthetic_report(spark):
    """Two queries, one found at the first place, one with no prediction: recall and mrr 0.5, no false match."""
    truths = spark.createDataFrame([("q1", "A", 1), ("q2", "A", 1)], "query_id string, grade string, n_truth int")
    rows = spark.createDataFrame([("q1", "c1", 0.9, 0.9, True), ("q2", "c2", 0.1, 0.1, False)], "query_id string, chunk_id string, cosine double, rerank double, relevant boolean")
    score = scoring.hybrid_score(F.col("cosine"), F.col("rerank"), 0.25)
    m = evaluation.metrics(evaluation.outcomes(rows, truths, score >= 0.6, score), truths).first()
    assert (m.recall_at_3, m.mrr_at_3, m.false_match_rate) == (0.5, 0.5, 0.0)
    assert not evaluation.quality_gate(spark.createDataFrame([m]), spark.createDataFrame([m])).first().passed
    best = evaluation.grid_search(rows.withColumn("grade", F.lit("A")), truths, [0.0, 0.5], [0.5, 0.8], 0.0, least=30).first()
    assert not best.enabled


def test_page_calibration(spark):
    seen = spark.createDataFrame([(1, p, p - 39) for p in (527, 547, 567)] + [(2, p, p - 5) for p in (10, 11, 12, 20)] + [(2, 15, 99), (2, 15, 10), (3, 5, 1), (3, 9, 5)], "library_id long, pdf_page long, printed_page long")
    best = {r.library_id: r.offset for r in pages.usual_offset(seen).collect()}
    assert best[1] == 39
    runs = pages.calibration_runs(seen)
    assert {(r.library_id, r.pdf_start, r.pdf_end, r.confidence) for r in runs.collect()} == {(2, 10, 20, "high")}
    mapped = {r.pdf_page: r.printed_page for r in pages.page_map(runs, seen).collect()}
    assert 15 not in mapped and mapped[14] == 9 and len(mapped) == 10


def test_third_question_promotes_a_tag(spark):
    rows = spark.createDataFrame([("s", "x", i, [], [t]) for i, t in enumerate(["Heart Failure", "heart-failure", "HEART.FAILURE"])], "set_id string, subject string, question_id long, tags array<string>, suggested array<string>")
    catalog, lists = tags.synced(rows)
    assert [(r.usage, r.name, r.status) for r in catalog.collect()] == [(3, "Heart Failure", "active")]
    assert all(r.tags == ["Heart Failure"] and r.suggested == [] for r in lists.collect())
    catalog, _ = tags.synced(rows.where("question_id < 2"))
    assert catalog.first().status == "candidate"


def test_delta_lists_changed_learning_fields(spark):
    base = spark.createDataFrame([(1, "q", "a"), (2, "q", "a")], "pk long, core string, note string")
    now = spark.createDataFrame([(1, "q", "b"), (2, "z", "a"), (3, "q", "a")], "pk long, core string, note string")
    got = {r.pk: (r.outcome, r.reason, r.fields) for r in delta.preflight(now, base, "pk", ["core"], ["note"]).collect()}
    assert got == {1: ("patch", "", ["note"]), 2: ("issue", "core changed", []), 3: ("issue", "no baseline", [])}


def test_list_cleanup(spark):
    assert one(spark, text.limited_list(F.lit("Alpha, alpha;b；Gamma、delta|eps"), 3, 24)) == ["Alpha", "Gamma", "delta"]
    assert one(spark, text.fill_answers(F.lit('[["a"],["b","c"]]'))) == [["a"], ["b", "c"]]
    assert one(spark, text.fill_answers(F.lit('[["a"],[]]'))) == []
    assert one(spark, text.key(F.lit("Ａ b-C．d"))) == "abcd"


def test_empty_list_is_not_all(spark):
    rows = spark.range(3)
    assert browse.with_ids(rows, None).count() == 3 and browse.with_ids(rows, []).count() == 0 and browse.with_ids(rows, [1]).count() == 1


def test_alias_chains_end(spark):
    aliases = {"a": "b", "b": "c", "x": "y", "y": "x"}
    assert one(spark, retrieval.aliased(F.lit(" A "), aliases)) == "c"
    assert one(spark, retrieval.aliased(F.lit("x"), aliases)) == "y"
    assert one(spark, retrieval.aliased(F.lit("none"), aliases)) == "none"


def test_approval_counts(spark):
    rows = spark.createDataFrame([(1, "pending", 0.9), (2, "pending", 0.1), (3, "pending", 0.9)], "id long, review_status string, s double")
    done, counts = status.approved(rows, F.col("s") > 0.5, rows.where("id < 3"), "id")
    assert {r.id: r.review_status for r in done.collect()} == {1: "approved", 2: "pending", 3: "pending"}
    assert tuple(counts.first()) == (1, 1)


def test_bad_text_fails_alone(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0] for _ in texts]

    got = {r.t: r.error for r in models.embedded(spark.createDataFrame([("a",), ("bad",), ("c",)], "t string").coalesce(1), "t", embed).collect()}
    assert got == {"a": "", "bad": "no", "c": ""}


def test_json_shapes(spark, tmp_path):
    q = {"id": "1", "question": "what", "options": ["A. x"], "answer": "A"}
    (tmp_path / "plain.json").write_text(json.dumps([q]))
    (tmp_path / "nested.json").write_text(json.dumps({"questions": [dict(q, id="2"), dict(q, id="3")]}))
    assert sorted(r.id for r in readers.questions_json(spark, str(tmp_path / "*.json")).collect()) == ["1", "2", "3"]
    chapters = [{"chapter": "c", "questions": [{"ID": "9", "type": "", "stem": "s", "options": [{"label": "A", "content": "x"}], "answer": "AB", "explanation": "e"}]}]
    (tmp_path / "Heart.jsn").write_text(json.dumps(chapters))
    row = readers.chapters_json(spark, str(tmp_path / "Heart.jsn"), {}).first()
    assert (row.subject, row.type, row.options) == ("Heart", "multiple", ["A. x"])


def test_text_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿心".encode())
    (tmp_path / "b.txt").write_bytes("心".encode("gb18030"))
    assert {r.text for r in readers.raw_text(spark, str(tmp_path)).collect()} == {"心"}
    assert readers.identities(spark, str(tmp_path), "*.txt").count() == 2


def test_paged_source(spark, tmp_path):
    readers.register_pages(spark, lambda path, n: (f"page {n}", "text", ""), lambda path: 7)
    rows = spark.read.format("paged").option("path", str(tmp_path)).option("pagesPerPartition", "3").option("startPage", "2").load()
    assert sorted(r.page_number for r in rows.collect()) == [2, 3, 4, 5, 6, 7]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "error", "a\x01b"), (2, " ", "generated", "c")], "id long, subject string, pipeline_status string, note string")
    writers.export_json(rows, str(tmp_path / "j"), by="subject")
    assert sorted(p.name for p in (tmp_path / "j").iterdir() if p.is_dir()) == ["subject_folder=none", "subject_folder=x"]
    writers.export_issues(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    assert writers.cells(rows).where("id = 1").first().note == "ab"
    for valid, count in ((False, 0), (True, 2)):
        done = writers.publish(rows, str(tmp_path / "p"), "id", spark.createDataFrame([(valid,)], "valid boolean"))
        assert done == valid
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stream_publishes_each_window_once(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for i in range(3):
        spark.createDataFrame([(i, "z" * 700, "en", "s", 700)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    for _ in range(2):
        index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_activity_of_a_stream(spark, sf, tmp_path):
    static = spark.read.parquet(f"{sf}/events.parquet")
    static.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = job_activity(spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg(F.sum("n")).first()[0] == static.count()


def test_markdown_round_trip(spark):
    got = one(spark, questions.from_markdown(F.lit("### a\nx\ny\n### b\nz")))
    assert [(b.section, b.text) for b in got] == [("a", "x\ny"), ("b", "z")]


def test_pages_without_a_printed_number(spark, sf):
    from lodestone.plans.catalog_more import seen

    events = spark.read.parquet(f"{sf}/events.parquet")
    assert seen(spark, sf).count() == events.count()
    rows = spark.createDataFrame([(1, p, None if p in (3, 9) else p - 2) for p in range(3, 10)] + [(1, 5, None), (2, 4, None)], "library_id long, pdf_page long, printed_page long")
    runs = pages.calibration_runs(rows)
    assert [(r.library_id, r.offset, r.pdf_start, r.pdf_end, r.support) for r in runs.collect()] == [(1, 2, 4, 8, 5)]
    assert {r.pdf_page for r in pages.page_map(runs, rows).collect()} == {4, 5, 6, 7, 8}
    assert [(r.library_id, r.offset, r.support) for r in pages.usual_offset(rows).collect()] == [(1, 2, 5)]

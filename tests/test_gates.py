"""Gates stay shut on nulls; canonical forms; strict schemas; attempts and repairs by pinned cases; rows that crashed."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import canonical, schemas
from lodestone.operators import attempts, batches, questions, sets, tags
from lodestone.sources import office


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# --- canonical forms


def test_canonical_form_is_the_same_for_width_order_and_space(spark):
    a = json.dumps({"b": "ﬁne　 text\n", "a": ["Ａ１", {"z": None, "y": 1.5}], "c": {"d": True}}, ensure_ascii=False)
    b = json.dumps({"c": {"d": True}, "a": ["A1", {"y": 1.5, "z": None}], "b": "fine text"})
    rows = spark.createDataFrame([(a,), (b,), (None,), ("{",), ('"x  y"',), ("",), ("[" * 5000 + "]" * 5000,)], "j string")
    found = [tuple(r) for r in rows.select(canonical.canonical_json("j"), canonical.json_fingerprint("j")).collect()]
    expected = '{"a": ["A1", {"y": 1.5, "z": null}], "b": "fine text", "c": {"d": true}}'
    assert found[0] == found[1] == (expected, hashlib.sha256(expected.encode()).hexdigest())
    assert found[2] == found[3] == found[5] == (None, None) and found[4][0] == '"x y"'
    assert one(spark, canonical.canonical_json(F.lit(b), ("c", "z"))) == '{"a": ["A1", {"y": 1.5}], "b": "fine text"}'


def test_names_and_texts(spark):
    rows = spark.createDataFrame([("Ｓtraße  ﬀ",), (None,), ("a_B-c.·D",), ("",)], "t string")
    assert [tuple(r) for r in rows.select(canonical.name_key("t"), canonical.nfkc("t")).collect()] == [("strasseff", "Straße ff"), (None, None), ("abcd", "a_B-c.·D"), ("", "")]


# --- strict schemas

GOOD = {"explanationBlocks": [{"section": "analysis", "type": "table", "title": "t", "rows": [["a"]], "tone": None}], "briefExplanation": "b", "tags": ["x"], "evidenceContext": None}


def change(**more):
    return json.dumps({k: v for k, v in {**GOOD, **more}.items() if v != "gone"})


CASES = [
    (json.dumps(GOOD), None), (None, "$: not JSON"), ("{", "$: not JSON"), ('{"tags": [], "tags": []}', "$: not JSON"), ("[]", "$: not an object"), ("null", "$: not an object"),
    (change(more=1), "$.more: unknown field"), (change(explanationBlocks="gone"), "$.explanationBlocks: missing"), (change(explanationBlocks=[]), "$.explanationBlocks: too few"),
    (change(explanationBlocks=GOOD["explanationBlocks"] * 9), "$.explanationBlocks: too many"), (change(explanationBlocks={}), "$.explanationBlocks: not a list"),
    (change(explanationBlocks=[*GOOD["explanationBlocks"], {"section": "analysis"}]), "$.explanationBlocks[1].type: missing"),
    (change(explanationBlocks=[{"section": "other", "type": "list"}]), "$.explanationBlocks[0].section: not one of the values"),
    (change(explanationBlocks=[{"section": "analysis", "type": "list", "title": "t" * 81}]), "$.explanationBlocks[0].title: too long"),
    (change(explanationBlocks=[{"section": "analysis", "type": "list", "rows": [["a", 1]]}]), "$.explanationBlocks[0].rows[0][1]: not text"),
    (change(tags=list("abcd")), "$.tags: too many"), (change(tags=[1]), "$.tags[0]: not text"), (change(briefExplanation=None), "$.briefExplanation: not text"), (change(briefExplanation="x" * 201), "$.briefExplanation: too long"),
    (change(evidenceContext={"contextSummary": "x"}), "$.evidenceContext.evidenceId: missing"), (change(evidenceExcerpts=[{"evidenceId": "E1", "highlights": [None]}]), "$.evidenceExcerpts[0].highlights[0]: not text"),
]


def test_first_faults_of_answers(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, answer string")
    found = schemas.checked(rows, "answer", schemas.PACKAGE, "tags array<string>, briefExplanation string").orderBy("i").collect()
    assert [r.fault for r in found] == [f for _, f in CASES]
    assert found[0].value.tags == ["x"] and all(r.value is None for r in found[1:])


def test_other_schemas(spark):
    def fault(node, value):
        return one(spark, schemas.fault(F.try_parse_json(F.lit(json.dumps(value))), node))

    assert fault(schemas.POINTS, {"items": [{"id": "1", "studyPoints": "text"}, {"id": "2", "studyPoints": [{"title": "t", "body": "b"}]}, {"id": "3"}]}) is None
    assert fault(schemas.POINTS, {"items": [{"id": "1", "studyPoints": 3}]}) == "$.items[0].studyPoints: not text"
    assert fault(schemas.CARDS, {"items": [{"id": "1", "memoryCards": [{"title": "", "content": "c"}]}]}) == "$.items[0].memoryCards[0].title: too short"
    assert fault(schemas.ORGANISED, {"items": [{"question": "q", "answer": [["a"]], "type": "A1"}]}) is None
    assert fault(schemas.ORGANISED, {"items": [{"question": "q", "type": "B9"}]}) == "$.items[0].type: not one of the values"
    assert fault(schemas.SUBJECTS, {}) is None and fault(schemas.TAGS, {"items": [{"id": 4}]}) == "$.items[0].id: not text"


# --- attempts

SCHEDULE = {
    "good": [{"value": "v"}], "slow": [{"status": 503}, {"status": 429, "retry_after": 9.0}, {"value": "v"}], "never": [{"status": 503}] * 5, "limited": [{"status": 429}] * 5, "silent": [None] * 5,
    "wrong": [{"status": 401}], "plainer": [{"status": 404}, {"status": 500}, {"status": 500}, {"value": "plain"}], "refused": [{"status": 404}, {"status": 404}], "invalid": [{"invalid": "grounding_failed", "value": "half"}],
}


def test_attempts_end_in_pinned_states(spark):
    waits, schedule = [], SCHEDULE

    def stub(some):
        return [schedule[r["id"]][r["attempt"]] for r in some]

    rows = spark.createDataFrame([(k, "pro" if k in ("plainer", "refused") else "fast", "fast") for k in SCHEDULE], "id string, model string, plain_model string")
    results, log = attempts.attempted(rows, "id", stub, batch=1, pause=waits.append)
    found = {r.id: (r.state, r.code, r.kind, r.value, r.attempts, r.model, r.fell_back) for r in results.collect()}
    assert found == {
        "good": ("done", "", "", "v", 1, "fast", False), "slow": ("done", "", "", "v", 3, "fast", False), "never": ("failed", "provider_timeout", "provider", None, 3, "fast", False), "limited": ("failed", "provider_rate_limited", "provider", None, 3, "fast", False),
        "silent": ("failed", "provider_timeout", "provider", None, 3, "fast", False), "wrong": ("failed", "provider_fatal", "provider", None, 1, "fast", False), "plainer": ("done", "", "", "plain", 4, "fast", True),
        "refused": ("failed", "provider_fatal", "provider", None, 2, "fast", True), "invalid": ("failed", "grounding_failed", "validation", "half", 1, "fast", False),
    }
    steps = {(r.id, r.attempt): r for r in log.collect()}
    assert len(steps) == sum(r[4] for r in found.values())
    assert steps["slow", 1].wait == 9.0 and 0.5 <= steps["slow", 0].wait < 1.5 and steps["plainer", 0].wait == 0 and steps["never", 2].wait == 0
    assert len(waits) == 3 and waits[1] == 9.0


def test_a_fatal_answer_stops_what_is_open(spark):
    answers = {"a": [{"status": 401, "fatal": True}], "b": [{"status": 503}], "c": [{"value": "v"}]}
    rows = spark.createDataFrame([(k, "m", "m") for k in answers], "id string, model string, plain_model string")
    results, _ = attempts.attempted(rows, "id", lambda some: [answers[r["id"]][r["attempt"]] for r in some], batch=1, pause=lambda s: None)
    assert {(r.id, r.state, r.attempts) for r in results.collect()} == {("a", "fatal", 1), ("b", "stopped", 1), ("c", "done", 1)}
    assert attempts.attempted(rows.limit(0), "id", lambda some: [])[0].count() == 0


def test_repairs_are_bounded_and_no_row_is_lost(spark):
    def first(rows):
        return [json.dumps({"subjects": ["s"] * r["id"]}) if r["id"] < 6 else None for r in rows]

    def again(rows):
        assert all(r["fault"] for r in rows)
        return [json.dumps({"subjects": ["fixed"]}) if r["id"] == 4 else "{" for r in rows]

    made = attempts.packaged(spark.createDataFrame([(i,) for i in range(8)], "id int"), first, again, F.lit('{"subjects": ["rule"]}'), schemas.SUBJECTS, "subjects array<string>", F.when(F.size("value.subjects") == 0, "no subject"))
    found = {r.id: (r.origin, r["round"], r.value.subjects, r.fault) for r in made.collect()}
    assert found == {
        0: ("rule", 2, ["rule"], "$: not JSON"), 1: ("model", 0, ["s"], None), 2: ("model", 0, ["s"] * 2, None), 3: ("model", 0, ["s"] * 3, None), 4: ("repaired", 1, ["fixed"], "$.subjects: too many"),
        5: ("rule", 2, ["rule"], "$: not JSON"), 6: ("rule", 2, ["rule"], "$: not JSON"), 7: ("rule", 2, ["rule"], "$: not JSON"),
    }


def test_faults_of_rankings(spark):
    asked = spark.createDataFrame([(i, 2) for i in range(8)], "query_id int, n int")
    rows = [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 0.1), (1, 2, 0.1), (2, 0, 0.1), (2, 0, 0.1), (3, 0, float("nan")), (3, 1, 0.1), (4, 0, 1.1), (4, 1, 0.0), (5, 1, 0.0), (6, None, 0.2), (6, 0, 0.2), (9, 0, 0.1)]
    found = attempts.rank_faults(spark.createDataFrame(rows, "query_id int, index int, score double"), asked)
    assert dict(found.collect()) == {0: "", 1: "index", 2: "repeated", 3: "score", 4: "score", 5: "missing", 6: "index", 7: "missing"}


# --- rows that crashed or were lost


def test_payloads_that_cannot_be_read_name_nothing(spark):
    jobs = spark.createDataFrame([(1, "queued", '{"set_id":"abc"}'), (2, "queued", '{"question_pk":"99999999999999999999999"}'), (3, "queued", '{"set_id":7}'), (4, "done", '{"question_ids":["11","x",null]}'), (5, "done", None), (6, "done", "{")], "job_id long, status string, payload string")
    held, own = spark.createDataFrame([(7,), (8,)], "set_id long"), spark.createDataFrame([(11, 8)], "id long, set_id long")
    assert {tuple(r) for r in sets.referring(jobs, held, own).collect()} == {(3, "queued", 7), (4, "done", 8)}
    assert {tuple(r) for r in sets.deletable(jobs, held, own).collect()} == {(7, 1, False), (8, 1, True)}


def test_rows_without_a_key_are_all_appended(spark):
    kind = "set_id long, external_id string, text string"
    new = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (1, "k", "z"), (1, "k", "y"), (1, "old", "c"), (2, "k", "no set")], kind)
    counted, whole, added = sets.appended(spark.createDataFrame([(1, 0)], "set_id long, question_count long"), spark.createDataFrame([(1, "old", "was")], kind), new)
    assert sorted((r.external_id or "", r.text) for r in added.collect()) == [("", "a"), ("", "b"), ("k", "y")]
    assert counted.first().question_count == whole.count() == 4


def test_items_without_an_id_are_issues(spark):
    kind = "ordinal long, source string, number long, bank string, id string, core string, content string, answer string, errors array<string>"
    items = spark.createDataFrame([(1, "s", 1, "school", None, "c1", "x", "A", None), (2, "s", 2, "school", "  ", "c2", "y", "B", []), (3, "s", 3, "school", "3", "c3", "z", "C", None)], kind)
    found = batches.preview(items, items.limit(0), "d")
    assert {(r.ordinal, r.status, r.reason) for r in found.collect()} == {(1, "issue", "no id"), (2, "issue", "no id"), (3, "ready", "")}


def test_rows_of_one_question_share_its_tags(spark):
    rows = spark.createDataFrame([(1, "s", 5, ["alpha"]), (1, "s", 5, ["beta"]), (1, "s", 6, ["alpha"])], "set_id long, subject string, question_id long, tags array<string>").withColumn("suggested", F.array().cast("array<string>"))
    _, whole = tags.synced(rows)
    assert {(r.question_id, *sorted(r.tags + r.suggested)) for r in whole.collect()} == {(5, "alpha", "beta"), (6, "alpha")}


def test_cells_beyond_the_last_column_are_faults():
    assert office._column("XFD12") == 16_383
    with pytest.raises(ValueError):
        office._column("XFE1")
    with pytest.raises(ValueError):
        office._column("ZZZZZZ1")


def test_null_lists_and_gates(spark):
    kind = "id string, subject string, question string, answer string, type string, difficulty string, options array<string>, tags array<string>, knowledge_points array<string>"
    rows = spark.createDataFrame([("1", "s", "q", "A", "A1", None, None, None, None), ("2", "s", "q", "A", "A1", "easy", ["A. x", None], [], []), ("3", "s", None, None, None, None, None, None, None), ("4", "s", "[1]", "x", "fill", None, None, None, None)], kind)
    found = {r.id: r.e for r in rows.select("id", questions.rule_errors().alias("e")).collect()}
    assert "fewer than two options" in found["1"] and found["2"] == ["empty option"] and found["4"] == []
    assert found["3"] == ["missing question", "missing answer", "unknown type"]
    yes, no, null = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    need = F.array(*map(F.lit, ("analysis", "answerBasis", "pitfalls")))
    gate = lambda **k: one(spark, sets.needs_manual(**({"text": F.lit("t"), "matched": yes, "package": yes, "tagged": yes, "brief": yes, "sections": need, "tabled": yes, "warned": no} | k)))
    assert gate() is False
    assert all(gate(**{k: null}) for k in ("matched", "tagged", "brief", "tabled", "warned"))
    assert gate(package=null, tagged=no) and not gate(package=null)

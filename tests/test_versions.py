"""Commits: versions read back exactly, refused ones leave nothing, emptied keys go."""

import glob

import pytest
from pyspark.sql import functions as F

from lodestone.operators import exchange
from lodestone.sources import readers, versions
from lodestone.store import kept

SCHEMA = "id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, version=None):
    return sorted((tuple(r) for r in versions.as_of(spark, path, version).collect()), key=repr)


def test_three_versions_read_back_and_unchanged_buckets_are_shared(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(i, f"a{i}") for i in range(200)] + [(None, "none"), (7, "a7")]
    assert versions.commit(frame(spark, first), path, "id", n_buckets=16) == 1
    assert versions.commit(frame(spark, [(3, "new"), (3, "newer"), (500, "more"), (None, "nil")]), path, "id") == 2
    assert versions.commit(frame(spark, []), path, "id", keys=spark.createDataFrame([(4,), (5,), (999,)], "id long")) == 3
    second = [r for r in first if r[0] not in (3, None)] + [(3, "new"), (3, "newer"), (500, "more"), (None, "nil")]
    third = [r for r in second if r[0] not in (4, 5)]
    assert [held(spark, path, v) for v in (1, 2, 3)] == [sorted(x, key=repr) for x in (first, second, third)]
    one, two = (versions.manifest(spark, path, v)["parts"] for v in (1, 2))
    assert 0 < sum(one[b] != two[b] for b in one) <= 3
    assert versions.restored(spark, path, 1) == 4 and held(spark, path) == sorted(first, key=repr)
    assert versions.vacuumed(spark, path, keep=[2]) == [1, 3]
    assert held(spark, path, 2) == sorted(second, key=repr) and held(spark, path) == sorted(first, key=repr)
    with pytest.raises(ValueError):
        versions.as_of(spark, path, 3)


def test_an_emptied_table_and_empty_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.commit(frame(spark, []), path, "id") == 1 and held(spark, path) == []
    versions.commit(frame(spark, [(1, "x"), (2, "y")]), path, "id")
    versions.commit(frame(spark, []), path, "id", keys=spark.createDataFrame([(1,), (2,)], "id long"))
    assert held(spark, path) == [] and held(spark, path, 2) == [(1, "x"), (2, "y")]
    versions.commit(frame(spark, [(9, "z")]), path, "id", everything=True)
    assert held(spark, path) == [(9, "z")]


def test_stale_and_invalid_commits_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(frame(spark, [(1, "x")]), path, "id")
    versions.commit(frame(spark, [(2, "y")]), path, "id")
    before = sorted(glob.glob(f"{path}/**/*", recursive=True))
    for wrong in ({"base": 1}, {"report": spark.sql("SELECT false AS valid")}):
        with pytest.raises(versions.Refused):
            versions.commit(frame(spark, [(3, "z")]), path, "id", **wrong)
    with pytest.raises(ValueError):
        versions.commit(frame(spark, [(3, "z")]), path, "id", keys=spark.createDataFrame([(4,)], "id long"))
    whole = frame(spark, [(3, "z"), (4, "w")])
    with pytest.raises(ValueError):  # keys of the same lineage as the rows
        versions.commit(whole, path, "id", keys=whole.where("id = 3").select("id"))
    with pytest.raises(ValueError):
        versions.commit(frame(spark, [(3, "z")]).withColumn("more", F.lit(1)), path, "id")
    with pytest.raises(versions.Refused):  # the number is taken between check and rename
        versions.Folder(spark, path).rename("_versions/000000000001.json", "_versions/000000000002.json")
    assert sorted(glob.glob(f"{path}/**/*", recursive=True)) == before
    assert held(spark, path) == [(1, "x"), (2, "y")]


def test_a_source_that_changed_meanwhile_refuses_the_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    path, read = str(tmp_path / "t"), lambda: readers.identities(spark, str(tmp_path / "in"))
    source = kept(read())
    assert versions.commit(frame(spark, [(1, "one")]), path, "id", source=source, source_now=read) == 1
    (tmp_path / "in/a.txt").write_text("two")
    with pytest.raises(versions.Refused):
        versions.commit(frame(spark, [(1, "two")]), path, "id", source=source, source_now=read)
    assert held(spark, path) == [(1, "one")] and versions.latest(spark, path) == 1


def test_exports_are_visible_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    questions = spark.createDataFrame([(1, "school", "q1"), (2, "school", "q2"), (3, "kaoyan", "q3")], "id long, bank string, question string")
    made = exchange.question_export(questions.withColumn("external_id", F.concat(F.lit("x"), "id")), path, "first", "s", "name", "test", "2026")
    assert made["counts"] == {"documents": 2, "mapping": 3}
    mapping = versions.exported(spark, path, "first", "mapping", "external_id string, id long, bank string")
    assert sorted(tuple(r) for r in mapping.collect()) == [("x1", 1, "school"), ("x2", 2, "school"), ("x3", 3, "kaoyan")]
    with pytest.raises(versions.Refused):
        exchange.question_export(questions, path, "first", "s", "name", "test", "2026")
    with pytest.raises(versions.Refused):
        exchange.question_export(questions.limit(0), path, "second", "s", "name", "test", "2026")
    broken = questions.withColumn("question", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        versions.export_together({"a": questions, "b": broken}, path, "third")
    assert [r.export for r in versions.export_history(spark, path).collect()] == ["first"]
    assert versions.Folder(spark, path).names() == ["first"]


def test_chosen_rows_are_exported_and_unknown_ones_reported(spark, tmp_path):
    questions = spark.createDataFrame([(i, "school", f"q{i}") for i in range(9)], "id long, bank string, question string")
    chosen = spark.createDataFrame([(3,), (3,), (5,), (77,), (None,)], "id long")
    made = exchange.export_selected(questions, chosen, str(tmp_path / "out"), "pick", "s", "name", "test", "2026")
    assert made["counts"] == {"documents": 1, "mapping": 2, "unknown": 1}
    with pytest.raises(versions.Refused):
        exchange.export_selected(questions, chosen.where("id = 77"), str(tmp_path / "out"), "none", "s", "name", "test", "2026")

"""The pipeline stage by stage against plain versions of each stage on the same input."""

import hashlib
from collections import Counter

import pytest
from test_llm_operators import WORD, slow_links, slow_rules

import corpus_pipeline
from lodestone.llm import mixing, spm
from lodestone.llm.runtime import cut


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, sf))
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_keep_clean_documents(spark, sf, stages):
    before, after = map(rows, stages["quality rules"])
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in before.items():
        n, _, _, _, again = slow_rules(r.text)
        if n < 10 or 100 * again > 20 * n:
            assert i not in after
        elif marks.get(i) == 1:
            assert after[i] == r
        elif marks.get(i) == 0:
            assert i not in after


def test_one_of_each_group_stays(stages):
    before, after = map(rows, stages["n-gram Jaccard join"])
    groups = slow_links({i: r.text for i, r in before.items()}, 5, 4, 5)
    assert set(after) == {i for i, (_, c) in groups.items() if c == i}


def test_nothing_but_repeated_passages_goes(stages):
    before, after = map(rows, stages["substring dedup"])
    assert set(before) == set(after)
    seen = Counter()
    for r in before.values():
        w = WORD.findall(r.text)
        seen.update({tuple(w[i : i + 12]) for i in range(len(w) - 11)})
    for i, r in before.items():
        w = WORD.findall(r.text)
        alone = all(seen[tuple(w[k : k + 12])] == 1 for k in range(len(w) - 11)) and len({*w}) > len(w) / 3
        assert after[i].n_chars == len(after[i].text) <= len(r.text)
        if alone:
            assert after[i].text == r.text


def test_copies_follow_the_quantile(stages):
    before, after = stages["mixing sources"]
    want = {r.doc_id: r.n_copies for r in mixing.counted(before).collect()}
    got = Counter(r.doc_id for r in after.collect())
    assert {i: n for i, n in want.items() if n} == dict(got)
    assert all(int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:12], 16) >= 0 for i in got)


def test_ids_equal_the_library(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    before, after = stages["SentencePiece"]
    texts = {r.doc_id: r.text for r in before.collect()}
    made = after.collect()
    assert len(made) == before.count()
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in made)


def test_run_is_all_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["SentencePiece"][1].count()


def test_pipeline_on_an_empty_table(spark, sf, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

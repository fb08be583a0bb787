"""Each pipeline stage against a brute-force version on a small table."""

import pytest
from test_text import linked

import corpus_pipeline as cp
from quillscan.llm import pii


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, now = {}, docs
    for name, stage in cp.STAGES:
        now = cp.written(stage(spark, now, ""), name).cache()
        out[name] = now
    return out


def test_columns_stay(stages, docs):
    for name in ("language_id", "near_duplicates", "personal_data", "mixing"):
        assert stages[name].columns == docs.columns


def test_language_stage_keeps_all_text_with_letters(stages, doc_rows):
    want = {r[0] for r in doc_rows if r[1] and any(c.isalpha() for c in r[1])}
    assert {r.doc_id for r in stages["language_id"].select("doc_id").collect()} == want


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages["language_id"].collect()]
    want = {k for k, (_, c) in linked(before).items() if k == c}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == want


def test_no_entity_is_left(stages):
    before = {r.doc_id for r in stages["near_duplicates"].collect()}
    after = stages["personal_data"].collect()
    assert {r.doc_id for r in after} == before
    assert all(not pii.base_spans(r.text.encode()) for r in after)


def test_mix_and_packing(stages):
    docs = {r.doc_id for r in stages["personal_data"].collect()}
    mixed = stages["mixing"].collect()
    assert {r.doc_id for r in mixed} <= docs and len(mixed) > len(docs)
    pieces = stages["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed}
    assert sum(r.start == 0 for r in pieces) == len(mixed)


def test_stages_of_an_empty_table(spark, no_docs):
    for _, stage in cp.STAGES:
        assert stage(spark, no_docs, "").count() == 0


def test_stages_keep_rows_apart_that_share_an_id_or_have_none(spark, doc_rows):
    """Ids that repeat or are null, null texts, a very long text: no stage crashes or loses a row that it should keep."""
    base = [r for r in doc_rows if r[0] < 40]
    prose = base[4][1]
    odd = [(1, prose + " one more ending", "aa", "s1", 5), (1, prose + " one more ending", "aa", "s1", 5), (None, prose + " and mail to a.b@c.example.org", "bb", None, None), (None, None, None, None, None), (2, "", "aa", "s0", 0), (77, "long " + prose * 400, "aa", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    now = spark.createDataFrame([r[:5] for r in base] + odd, schema).repartition(3)
    kept = []
    for name, stage in cp.STAGES[:4]:
        now = cp.written(stage(spark, now, ""), name)
        kept.append(now.collect())
    language, near, clean, mixed = kept
    assert sorted(str(r.doc_id) for r in language) == sorted(str(r[0]) for r in base + odd if r[1] and any(c.isalpha() for c in r[1]))
    assert len([r for r in near if r.doc_id is None]) == 1 and len({r.doc_id for r in near}) == len(near)
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(r.doc_id) for r in near)
    lone = next(r for r in clean if r.doc_id is None)
    assert "a.b@c.example.org" not in lone.text and lone.n_chars == len(lone.text)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    pieces = cp.STAGES[4][1](spark, now, "").collect()
    assert sum(r.start == 0 for r in pieces) == len(mixed)

"""Each operator on awkward rows and on an empty table, and each stage of the pipeline."""

import pytest

import corpus_pipeline
from askwell.llm.decontaminate import contaminations, decontaminated
from askwell.llm.language import identified, languages
from askwell.llm.line_dedup import deduplicated, line_dedup
from askwell.llm.minhash import near_duplicates, one_of_each
from askwell.llm.packing import packed
from askwell.llm.quality_model import quality_scores
from askwell.llm.quality_rules import quality_rules
from askwell.llm.secret_scan import secrets
from askwell.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "Some words in a short text, nothing more to say.")], "item_id bigint, text string")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_languages(odd_docs, no_docs):
    rows = by_id(languages(odd_docs))
    assert sum(map(len, rows.values())) == 10
    assert all(rows[i][0]["lang_pred"] == "und" and rows[i][0]["score"] == 0 for i in (2, 3, 4, 8))
    assert rows[5][0]["lang_pred"] in ("en", "zz") and 0 <= rows[5][0]["score"] <= 1
    assert rows[1][0] == rows[1][1]
    assert languages(no_docs).count() == 0
    assert identified(odd_docs).columns == odd_docs.columns
    assert {r["doc_id"] for r in identified(odd_docs).collect()} & {2, 3, 4, 8} == set()


def test_token_counts(odd_docs, no_docs):
    rows = by_id(token_counts(odd_docs))
    assert all(rows[i][0]["n_tokens"] == 0 for i in (2, 3, 4)) and rows[5][0]["n_words"] == 39000
    assert rows[1][0] == rows[1][1] and token_counts(no_docs).count() == 0


def test_secrets(odd_docs, no_docs):
    rows = by_id(secrets(odd_docs))
    assert {r["spans"] for v in rows.values() for r in v} == {""}
    assert len({r["base_sha256"] for v in rows.values() for r in v}) == 1 and secrets(no_docs).count() == 0


def test_quality_rules(odd_docs, no_docs):
    rows = by_id(quality_rules(odd_docs))
    assert rows[2][0]["n_words"] == 0 and not rows[2][0]["kept"] and rows[5][0]["base_failed"] and rows[1][0] == rows[1][1]
    assert rows[5][0]["n_repeat_words"] == 39000 and rows[5][0]["n_dup_lines"] == 2999
    assert quality_rules(no_docs).count() == 0


def test_quality_scores(odd_docs, no_docs, labels):
    rows = by_id(quality_scores(odd_docs, labels))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for v in rows.values() for r in v)
    assert rows[2][0]["score"] == rows[3][0]["score"]
    assert quality_scores(no_docs, labels).count() == 0
    assert {r["score"] for r in quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_near_duplicates(odd_docs, no_docs):
    rows = by_id(near_duplicates(odd_docs))
    assert all(rows[i][0]["n_shingles"] == 0 and rows[i][0]["component_id"] == i and rows[i][0]["kept"] for i in (2, 3, 4))
    assert rows[6][0]["n_shingles"] == 1 and len(rows[1]) == 2 and rows[None][0]["component_id"] is None and rows[None][0]["kept"]
    assert near_duplicates(no_docs).count() == 0
    left = one_of_each(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_line_dedup(odd_docs, no_docs):
    rows = by_id(line_dedup(odd_docs))
    assert sum(map(len, rows.values())) == 10 and rows[2][0]["text"] is None and rows[3][0]["text"] == ""
    assert rows[1][0]["text"] == rows[1][1]["text"] == "Some words in a short text, nothing more to say."
    assert line_dedup(no_docs).count() == 0 and deduplicated(odd_docs).columns == odd_docs.columns


def test_decontamination(odd_docs, no_docs, items):
    found = contaminations(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in found} == {(1, 3, True)}
    assert contaminations(no_docs, items).count() == 0 and contaminations(odd_docs, items.limit(0)).count() == 0
    left = decontaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == 8


def test_packing(odd_docs, no_docs):
    rows = by_id(packed(odd_docs))
    assert sum(r["length"] for r in rows[2]) == 1 and sum(r["length"] for r in rows[5]) == rows[5][0]["doc_tokens"]
    assert sum(r["length"] for r in rows[1]) == 2 * rows[1][0]["doc_tokens"] and None in rows
    assert packed(no_docs).count() == 0


def test_stages_on_awkward_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns

import os

import pytest

import __spark_entry__
import corpus_pipeline as C
from searchlake.llm import language, quality
from tests.llm.test_table_operators import plain_components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in C.STAGES][2] == "n-gram Jaccard join" and len(C.STAGES) == 5


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_filters_follow_the_classifiers(spark, docs):
    kept = {r.doc_id for r in C.language_id(spark, docs, SF).collect()}
    judged = language.predict(docs, language.fit(docs)).collect()
    assert kept == {r.doc_id for r in judged if r.lang_pred != "und"}
    good = C.quality_filter(spark, docs, SF)
    assert good.columns == docs.columns
    scores = quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores if r.predicted == 1}


def test_one_document_of_a_group_stays(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = C.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_components(rows)})


def test_mixing_keeps_all_rows(spark, docs):
    mixed = C.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()


def test_run_equals_its_stages(spark, docs):
    rows = C.run(spark, SF).collect()
    table = docs
    for _, stage in C.STAGES[:-1]:
        table = stage(spark, table, SF)
    kept = {r.doc_id for r in table.collect()}
    assert {r.doc_id for r in rows} == kept
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert len(r.ids) == 4 * r.length
    assert whole == {r.doc_id: r.doc_tokens for r in rows}


@pytest.fixture
def odd_dir(spark, odd_docs, tmp_path):
    """A folder with odd documents and labels that say nothing."""
    odd_docs.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (4, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, odd_docs, odd_dir):
    """Nulls, empty texts, repeated rows and clashing columns: each stage keeps what it must, with the columns of its input."""
    kept = C.language_id(spark, odd_docs, odd_dir)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "None", "4", "5", "6", "6", "8"])
    assert C.quality_filter(spark, odd_docs, odd_dir).count() == odd_docs.count()
    single = C.near_duplicates(spark, odd_docs, odd_dir)
    assert single.columns == odd_docs.columns and sorted(str(r.doc_id) for r in single.collect()) == sorted(["1", "2", "3", "None", "5", "6", "7", "8"])
    assert sorted(map(str, C.mix_sources(spark, odd_docs, odd_dir).collect())) == sorted(map(str, odd_docs.collect()))
    assert {r.doc_id for r in C.run(spark, odd_dir).collect()} == {1, None, 5, 6, 8}


def test_stages_on_empty_tables(spark, no_docs, odd_dir):
    for _, stage in C.STAGES:
        assert stage(spark, no_docs, odd_dir).count() == 0
    assert C.language_id(spark, no_docs.select("doc_id", "text", "lang", "source"), odd_dir).columns == ["doc_id", "text", "lang", "source"]

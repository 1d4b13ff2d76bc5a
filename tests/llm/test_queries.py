"""The registered queries: the statements of those that have one, and the columns of all."""

import os

import pytest

from searchlake.llm import queries
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_imatch": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_repair_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_pfair_mix": "doc_id bigint, source string, position bigint",
    "op6_url_rules": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_collision_counting": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_byte_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_kernel_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op12_repetition": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op13_drift_rewrite": "file_no bigint, version bigint, n_rows bigint, n_nulls bigint, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_duckdb(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    found = queries.QUERIES[name](spark, SF)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    if name == "op13_drift_rewrite":  # its rows are files
        return
    table, key = {"op6_url_rules": ("pages", "page_id"), "op7_collision_counting": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    if name == "op7_collision_counting":
        assert {r[0] for r in found.select("query_id").collect()} == {i for i in ids if i % 50 == 0}
    else:
        assert {r[0] for r in found.select(key).collect()} == ids

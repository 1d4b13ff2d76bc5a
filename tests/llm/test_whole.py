"""Operators of the training-data pipeline do the whole job."""

import pytest

import corpus_pipeline
from searchlake.llm import license_scan, mixing


@pytest.mark.parametrize(
    "text, labels",
    [("the gnu s general public license version 3 applies", "gpl,gpl-3.0"), ("under the GNU Leser General Public License", "gpl,lgpl"), ("GNU General Public License version 3", "gpl,gpl-3.0")],
)
def test_inner_notice_keeps_the_longer_one(text, labels):
    assert license_scan.Scanner().scan(text)["labels"] == labels


def test_edited_place_before_an_exact_one():
    places = license_scan.Scanner().scan("all rights reservd all rights reserved all right reserved")["places"]
    assert [(p[0], p[2], p[3], p[4]) for p in places] == [("reserved", 1, 19, 1), ("reserved", 20, 39, 0), ("reserved", 40, 58, 1)]


def test_packing_follows_the_schedule(spark, tmp_path):
    rows = [(i, "a b c d e f g h " * 600, "en", f"src{i % 3 if i % 2 else 0}", 9600) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    positions = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    # every document fills a sequence at once: those come in the order in which documents are read
    pieces = [r for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect() if r.start == 0 and r.length == 4096]
    assert len(pieces) == 200
    order = [positions[r.doc_id] for r in sorted(pieces, key=lambda r: r.sequence_id)]
    assert order == list(range(200))


def test_schedule_order_keeps_odd_rows(odd_docs, no_docs):
    kept = corpus_pipeline.in_schedule_order(odd_docs).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, odd_docs.select("doc_id", "text").collect()))
    assert corpus_pipeline.in_schedule_order(no_docs).count() == 0

"""Cases of the fourth round's findings."""

import re

import duckdb
import pytest

from searchlake.catalog import all_oracles, all_queries
from searchlake.functions import html as H
from searchlake.operators import search as S

UNITS = "query_id long, plain boolean, units array<struct<leaf:int,key:string,weight:double>>, steps array<struct<kind:string,a:int,b:int,c:int>>"


def test_bytes_count_after_white_space_is_collapsed(spark, tmp_path):
    """An article is enough from 501 bytes on, of which runs of blanks are one; a one-shot crawl takes texts as they are."""
    pages = []
    for n in range(496, 506):
        for gap in (" ", " \n\t ", " <br> "):  # the blanks at both ends count nothing
            body = gap.join(["é" * 100, "x" * 100, "y" * 100, "z" * (n - 403)])
            pages.append((len(pages), "https://a.org/", f"<title>t</title><body><nav>menu</nav><article> {body} </article> end</body>"))
            assert H.facts(pages[-1][2], 6500, ("content",))["content"].startswith("menu") == (n <= 500)
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_main_text", "one_shot_crawl"):
        assert sorted(map(tuple, all_queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(all_oracles()[name]).fetchall())
    assert H.facts(f"<body>m<article>{'x ' * 99}  {'é'}</article>", 6500, ("one_shot",))["one_shot"].startswith("x x")  # 202 bytes, 200 when collapsed


def test_postings_move_once_however_many_queries_ask(spark):
    """The postings went to every block of queries; now the queries follow them through every block of documents."""
    held = spark.createDataFrame([(d, f"k{d % 3}", 1.0) for d in range(30)], "doc_id long, key string, part double")
    asked = S.kept(spark.createDataFrame([(q, True, [(0, f"k{q % 3}", 1.0)], []) for q in range(20)], UNITS), "asked")
    found = S.met(asked, held, 30, docs=10, queries=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate explode" in line and re.search(r"\bpart#", line)]
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(q, d) for q in range(20) for d in range(q % 3, 30, 3)]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_blocks_do_not_depend_on_batches(spark, rows):
    """Postings and queries come in batches of any size; rows of one document and key, also of a null one, count together; odd keys and weights stay exact."""
    odd = 'content:"\\ \'\t\u00e9\u4e2d'
    held = [(1, "a", 0.1), (1, "a", 0.2), (1, "b", 4.0), (2, "a", 1.0), (None, "b", 2.0), (None, "b", 3.0), (3, odd, 1 / 3), (4, "c", 1.0)]
    steps = [("leaf", 0, 0, 0), ("leaf", 1, 0, 0), ("bool", 1, 0, 1)]  # the first and not the second
    asked = [(7, True, [(0, "a", 1.0), (0, "b", 0.5)], []), (8, False, [(0, "a", 2.0), (1, "b", 1.0)], steps), (9, True, [(0, odd, 3e5 / 7)], []), (10, True, [(0, "none", 1.0)], []), (11, True, [(0, "b", float("inf"))], [])]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        found = S.met(S.kept(spark.createDataFrame(asked, UNITS), "asked"), spark.createDataFrame(held, "doc_id long, key string, part double"), 5, docs=2).collect()
    finally:
        spark.conf.set(key, before)
    inf = float("inf")
    want = [(7, 1, 2.3), (7, 2, 1.0), (7, None, 2.5), (8, 2, 2.0), (9, 3, round(1e5 / 7, 6)), (11, 1, inf), (11, None, inf)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)

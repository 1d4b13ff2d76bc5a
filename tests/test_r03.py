"""Cases of the third round's findings."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from searchlake.catalog import all_queries
from searchlake.operators import search as S
from searchlake.operators import vectors as V
from searchlake.session import load

SMALL = "/root/testdata/sf0.001"


def test_softmax_names_its_logits_once(spark):
    """An expression that a lambda names is computed for every element that the lambda is called for."""
    assert str(V.softmax(F.col("logits"), 1.2)).count("logits") == 1
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "logits array<double>").select(V.softmax(F.col("logits"), 1.0).alias("p")).first()
    assert [round(p, 6) for p in row.p] == [0.090031, 0.244728, 0.665241]


def test_probe_binds_vectors_before_its_lambdas(spark):
    plan = all_queries()["probe_softmax"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    logits = next(line for line in plan.splitlines() if "exp(" in line.lower())
    assert len(re.findall(r"\bcs#\d+", logits)) <= 2  # the classes of the labels, and of the logits


def test_no_sketch_for_every_part(spark):
    """Beside a distinct count in the same aggregate, every part would get a sketch of the parts."""
    df = all_queries()["ext_approximate_counts"](spark, SMALL)
    aggregates = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct" in line]
    assert aggregates and all("keys=[]" in line for line in aggregates)


def _shuffled(df):
    """The exchanges by keys of a plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_postings_are_counted_in_their_rows(spark):
    rows = [(1, "b a b"), (2, ""), (3, None), (4, "é b É é"), (5, "a a"), (5, "a b"), (5, "c")]
    index = S.build(spark.createDataFrame(rows, "doc_id long, content string"), ("content",))
    assert sorted((r.term, r.doc_id, r.dl, r.tf) for r in index.postings.collect()) == [("a", 1, 3, 1), ("a", 5, 2, 3), ("b", 1, 3, 2), ("b", 4, 4, 1), ("b", 5, 2, 1), ("c", 5, 1, 1), ("é", 4, 4, 3)]
    assert sorted((r.term, r.df, r.cf) for r in index.terms.collect()) == [("a", 2, 4), ("b", 3, 4), ("c", 1, 1), ("é", 1, 3)] and index.count == 7
    assert not _shuffled(S._listed(spark.createDataFrame([(1, "content", ["a"])], "doc_id long, field string, w array<string>")))
    assert not _shuffled(index.postings)


def test_pairs_of_queries_and_documents_stay_in_their_blocks(spark):
    """The pairs that share a word are made inside a block; a shuffle by (query_id, doc_id) would move all of them."""
    docs = spark.createDataFrame([(i, f"common word{i % 3} tail a b") for i in range(60)], "doc_id long, content string")
    index = S.build(docs, ("content",))
    asked = spark.createDataFrame([(1, "common word1"), (2, 'word2 AND "a b"'), (3, '"b a"')], "query_id long, text string")
    found = S.scores(asked, index)
    assert not [line for line in _shuffled(found) if "query_id" in line and "doc_id" in line]
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(1, i) for i in range(60)] + [(2, i) for i in range(2, 60, 3)]
    topics = spark.createDataFrame([(1, "common"), (1, "word1"), (1, "none"), (2, "word2")], "query_id long, term string")
    assert sorted((r.query_id, r.doc_id, r.score) for r in S.shared(topics, index, 2).collect()) == [(1, i, 2.0) for i in range(1, 60, 3)]


def test_small_blocks_find_the_same(spark):
    held = spark.createDataFrame([(d, f"k{k}", float(d % 7 + k)) for d in range(40) for k in range(3) if (d + k) % 2], "doc_id long, key string, part double")
    asked = spark.createDataFrame([(q, True, [(0, f"k{q % 3}", 1.0 + q), (1, "k1", 0.5)], []) for q in range(5)], "query_id long, plain boolean, units array<struct<leaf:int,key:string,weight:double>>, steps array<struct<kind:string,a:int,b:int,c:int>>")
    whole, cut = (sorted(map(tuple, S.met(asked, held, 40, docs=d, queries=q).collect())) for d, q in ((4096, 512), (3, 2)))
    assert whole == cut and len(whole) > 100
    best = {q: sorted((r for r in whole if r[0] == q), key=lambda r: (-r[2], r[1]))[:4] for q in range(5)}
    found = sorted(map(tuple, S.met(asked, held, 40, top=4).collect()))
    assert found == sorted(r for rows in best.values() for r in rows)


def test_python_gets_small_batches(spark):
    """Of a partition with more rows, no batch that a worker holds has over 1,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        for name in ("clean_content", "crawl_to_index", "platt_fit", "spell_ladder"):
            all_queries()[name](spark, SMALL)
            assert int(spark.conf.get(key)) <= 1000
            spark.conf.set(key, "10000")
        load(spark, SMALL, "pages")
        sizes = spark.range(0, 3500, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) <= 1000
    finally:
        spark.conf.set(key, before)

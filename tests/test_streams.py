import json
import os

import pytest

from searchlake.plans import streams as batch
from searchlake.sources import readers
from searchlake.streaming import streams as S

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """The events in three files by time, so that streams have several triggers."""
    path = str(tmp_path_factory.mktemp("landing") / "events")
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "cast(props as string) as props")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_counts(spark, landing, tmp_path):
    got = drain(S.tumbling_counts(S.read_events(spark, landing, 1)), "tumbling", "complete", tmp_path)
    want = spark.read.parquet(landing).groupBy().count().first()[0]
    assert got.agg({"n": "sum"}).first()[0] == want


def test_gate_equals_its_batch_twin(spark, landing, tmp_path):
    events = S.read_events(spark, landing, 3).where("event_type = 'view'")
    got = {(r.user_id, r.event_id): r.accepted for r in drain(S.gate(events, 86_400_000_000), "gated", "append", tmp_path).collect()}
    assert got == {(r.user_id, r.event_id): r.accepted for r in batch.domain_gate(spark, SF).collect()}


def test_average_equals_its_batch_twin(spark, landing, tmp_path):
    rows = drain(S.moving_average(S.read_events(spark, landing, 3)), "averaged", "update", tmp_path).collect()
    last = {}
    for r in rows:
        if r.n >= last.get(r.user_id, (0, 0))[0]:
            last[r.user_id] = (r.n, r.ewma)
    for r in batch.latency_ewma(spark, SF).collect():
        assert last[r.user_id][0] == r.n and abs(last[r.user_id][1] - r.ewma) < 1e-5


def test_rate_signal_and_sessions_run(spark, landing, tmp_path):
    assert drain(S.rate_signal(S.read_events(spark, landing, 3)), "rates", "complete", tmp_path).count() > 0
    assert drain(S.first_seen(S.read_events(spark, landing, 1), "user_id", "60 days"), "seen", "append", tmp_path).count() == spark.read.parquet(landing).select("user_id").distinct().count()
    assert drain(S.sessions(S.read_events(spark, landing, 3), "6 hours"), "sessions", "complete", tmp_path).count() > 0


def test_crawl_loop(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    out = [str(tmp_path / x) for x in ("pages", "index", "frontier", "ckpt")]
    S.crawl_loop(spark, *out).trigger(availableNow=True).start().awaitTermination(120)
    index = S.latest_versions(spark, out[1])
    assert 0 < index.count() <= pages.count() and index.select("url").distinct().count() == index.count()
    assert spark.read.parquet(out[2]).count() > 0


def test_adaptive_concurrency():
    c = S.AdaptiveConcurrency(10)
    assert c.observe(10, 10.0) == 8 and c.observe(1, 0.0) == 8
    for _ in range(40):
        c.observe(30, 0.1)
    assert c.target == 30


def test_snapshot_defaults(spark, tmp_path):
    old = tmp_path / "v0.json"
    old.write_text(json.dumps({"queue": [{"url": "https://a.org/", "priority": 0.5}], "content_cap": 12000}))
    row = readers.queue_snapshot(spark, str(old)).first()
    assert (row.version, row.max_queue_size, row.content_cap, row.seen_urls) == (0, 50_000, 6500, [])
    assert readers.frontier(readers.queue_snapshot(spark, str(old))).first().url == "https://a.org/"


def test_programmes_and_corpus(spark, tmp_path):
    config = tmp_path / "p.json"
    config.write_text(json.dumps({"programs": [{"id": "a", "priority": 1, "fallback_url": "https://example-shop.com/"}, {"id": "b", "priority": 9, "fallback_url": "https://shop.org/"}]}))
    rows = readers.programmes(spark, str(config)).collect()
    assert [(r.id, r.fallback_url) for r in rows] == [("b", "https://shop.org/"), ("a", None)]
    corpus = tmp_path / "c.csv"
    corpus.write_text("query,expected,predicted,confidence,correct,top_score,result_count,time_ms\nhi,chitchat,,,,,,\n")
    assert readers.labelled_queries(spark, str(corpus)).first().predicted is None


def test_index_table(spark, tmp_path):
    path = str(tmp_path / "idx")
    spark.createDataFrame([("u", "t", "c", 1, 0.5, None, None)], readers.INDEX).repartition(3).write.parquet(path)
    assert readers.open_index(spark, path)[1] == "open"
    assert readers.compact(spark, path, path + "2") == 1 and readers.table_stats(spark, path + "2")["documents"] == 1
    spark.read.parquet(path).selectExpr("*", "array(1.0) as embedding").write.parquet(path + "3")
    rows, what = readers.open_index(spark, path + "3")
    assert what == "rebuild" and "embedding" not in rows.columns
    spark.range(1).write.parquet(path + "4")
    assert readers.open_index(spark, path + "4")[1] == "recreate"
    assert readers.media(spark.createDataFrame([("t", "u")], "title string, url string"), "news").columns == ["title", "url", "description", "published_at", "source", "score"]

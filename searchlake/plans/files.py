"""Queries over files that they write first: snapshots, configuration, corpora, index tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions.dialect import quoted
from searchlake.session import load
from searchlake.sources import readers
from searchlake.sources.folders import fresh_folder

EACH = 500  # entries of a snapshot


@query("S13", "X9", "O13", sql=f"""select url, 0.5::double as priority, case when page_id // {EACH} % 2 = 0 then 1 else 0 end as version, 6500 as content_cap, case when page_id // {EACH} % 2 = 0 then 7 else 5 end as most_discovered
    from pages where url is not null""")  # fmt: skip
def queue_snapshots(spark, sf_dir):
    """Snapshots of two versions, of a bounded number of entries each, written and loaded: what an old one lacks gets its default, the cap is held."""
    path = fresh_folder(spark, "snapshots")
    pages = load(spark, sf_dir, "pages").where("url is not null").select("url", F.floor(F.col("page_id") / EACH).alias("part"))
    entry = F.struct("url", F.lit(0.5).alias("priority"), F.lit("seed").alias("source"), F.lit("page").alias("content_type"), F.lit(0).cast("long").alias("discovered_at"), F.lit(0).alias("attempts"))
    now = F.col("part") % 2 == 0
    rows = pages.groupBy("part").agg(F.collect_list(entry).alias("queue"))
    rows = rows.select("part", F.when(now, 1).alias("version"), "queue", F.when(now, 7).alias("max_discovered_per_page"), F.when(now, 12_000).alias("content_cap"))
    rows.write.partitionBy("part").json(path)
    found = readers.queue_snapshot(spark, path)
    return found.select(F.explode("queue").alias("q"), "version", "content_cap", F.col("max_discovered_per_page").alias("most_discovered")).select("q.url", "q.priority", "version", "content_cap", "most_discovered")


_PROGRAMMES = [
    {"id": "direct", "kind": "program", "enabled": True, "priority": 20, "network": "net", "template": "{url}?subid={host}", "host_suffix": "example.com", "fallback_url": "https://shop.test/x"},
    {"id": "wide", "kind": "catch_all", "enabled": True, "priority": 5, "network": "wide", "template": "https://go.wide.io/?u={url}", "fallback_url": "https://wide.io/home"},
    {"id": "off", "kind": "program", "enabled": False, "priority": 20, "network": "net", "template": "{url}", "host_suffix": "shop.io"},
]


@query("S14", sql="select * from (values " + ", ".join(f"({quoted(p['id'])}, {p['priority']}, {str(p['enabled']).lower()}, {quoted(p['fallback_url']) if p['id'] == 'wide' else 'null'})" for p in _PROGRAMMES) + ") as t(id, priority, enabled, fallback_url)")
def programme_config(spark, sf_dir):
    """Affiliate programmes from a JSON document; a fallback on a reserved host is dropped."""
    path = fresh_folder(spark, "programmes")
    spark.createDataFrame([(json.dumps({"programs": _PROGRAMMES}),)], "value string").coalesce(1).write.text(path)
    return readers.programmes(spark, path).select("id", "priority", "enabled", "fallback_url")


@query("S15", "G10", sql="select role as expected, count(*)::bigint as n, count(*) filter (where turn % 3 <> 0)::bigint as predicted, count(*) filter (where turn % 3 = 1)::bigint as correct from conversations where conv_id is not null and turn is not null and role is not null group by 1")
def labelled_corpus(spark, sf_dir):
    """A labelled corpus as CSV, written and read: texts with quotes, commas and line ends survive, missing predictions stay missing."""
    path = fresh_folder(spark, "corpus")
    c = load(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and role is not null")
    rows = c.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("query"), F.col("role").alias("expected"), F.expr("case turn % 3 when 1 then role when 2 then 'other' end").alias("predicted"), F.lit(0.5).alias("confidence"))
    rows = rows.select("*", F.lit(None).cast("string").alias("correct"), *(F.lit(None).cast("double").alias(x) for x in ("top_score", "result_count", "time_ms")))
    rows.write.option("header", True).csv(path)
    found = readers.labelled_queries(spark, path)
    return found.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), F.count("predicted").alias("predicted"), F.count_if(F.col("predicted") == F.col("expected")).alias("correct"))


@query("S20", "S10", "O11", sql="select count(*)::bigint as documents, count(distinct url)::bigint as urls, 1 as segments from pages")
def index_compaction(spark, sf_dir):
    """An index in many small files, rewritten in files of a given size: all rows in fewer segments."""
    many, few = fresh_folder(spark, "index"), fresh_folder(spark, "compacted")
    load(spark, sf_dir, "pages").select("page_id", "url").repartition(7).write.parquet(many)
    readers.compact(spark, many, few)
    stats = readers.table_stats(spark, few)
    return spark.read.parquet(few).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("url").alias("urls"), F.lit(stats["segments"]).alias("segments"))


@query("G22", sql="select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint as g, count(*)::bigint as n, sum(l_quantity)::double as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def ext_cube(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("G22", sql="select l_shipmode_group, l_returnflag, count(*)::bigint as n from (select l_linenumber as l_shipmode_group, l_returnflag from lineitem) group by grouping sets ((l_shipmode_group), (l_returnflag), ())")
def ext_grouping_sets(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("l_shipmode_group"), "l_returnflag")
    a, b = F.col("l_shipmode_group"), F.col("l_returnflag")
    return rows.groupingSets([[a], [b], []], a, b).agg(F.count(F.lit(1)).alias("n"))


@query("G22", sql="select count(distinct l_partkey)::bigint as parts, true as close from lineitem")
def ext_approximate_counts(spark, sf_dir):
    """Distinct parts, and whether the sketch of them is within its error."""
    parts = load(spark, sf_dir, "lineitem").select("l_partkey")
    # one aggregate each: beside a distinct count, every part would get a sketch of its own
    sketch, exact = parts.agg(F.approx_count_distinct("l_partkey", 0.01).alias("a")), parts.agg(F.count_distinct("l_partkey").alias("n"))
    found = sketch.crossJoin(exact)  # one row each
    return found.select(F.col("n").alias("parts"), (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))

"""Evaluation and calibration queries: predictions are content quality, truth is the quality label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions import text as T
from searchlake.functions.dialect import quantised, sql_quantised
from searchlake.operators import calibrate as K
from searchlake.session import load, spread

_P = f"with e as (select *, {T.sql_entropy('text')} as h from documents), p as (select doc_id, source, quality as y, {sql_quantised('least(' + T.sql_quality_from('text', 'h') + ', 1.0) * 0.9 + (doc_id % 10) * 0.01')} as p from e join labels using (doc_id) where quality is not null)"


def predictions(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents")).withColumn("m", T.measures(F.col("text")))
    d = d.select("doc_id", "source", quantised(T.quality_from(F.col("text"), F.col("m")) * 0.9 + (F.col("doc_id") % 10) * 0.01).alias("p"))
    return d.join(load(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query("G10", "J16", sql=f"{_P} select source, count(*)::bigint as n, {sql_quantised('avg(((p >= 0.9)::int = y)::int)')} as accuracy from p group by 1")
def label_accuracy(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), quantised(F.avg(((F.col("p") >= 0.9).cast("int") == F.col("y")).cast("int"))).alias("accuracy"))


@query("G11", sql=f"{_P}, c as (select p, count(*) as k, sum(y) as pos from p group by 1), r as (select *, sum(k - pos) over (order by p rows between unbounded preceding and 1 preceding) as below from c), t as (select sum(pos) as np, sum(k - pos) as nn from c) select {sql_quantised('(select sum(pos * (coalesce(below, 0) + (k - pos) / 2.0)) from r) / (np * nn)')} as auc, np::bigint as positives, nn::bigint as negatives from t")
def auc_rank_sum(spark, sf_dir):
    return K.auc(predictions(spark, sf_dir), "p", "y")


@query("G12", sql=f"{_P}, b as (select least(9, floor(10 * p)) as bin, count(*) as n, avg(p) as mp, avg(y) as my from p group by 1) select {sql_quantised('sum(n * abs(mp - my)) / sum(n)')} as ece, count(*)::bigint as bins from b")
def ece_bins(spark, sf_dir):
    return K.ece(predictions(spark, sf_dir), "p", "y")


@query("G13", sql=f"{_P}, s as (select list_sort(list(p)) as v from p) select v[len(v) // 20 + 1] as p05, v[len(v) // 2 + 1] as p50, v[len(v) * 19 // 20 + 1] as p95 from s")
def score_spread(spark, sf_dir):
    return K.spread(predictions(spark, sf_dir), "p")


def _rounded(found: str) -> str:
    return f"select round(slope, 4) as slope, round(intercept, 4) as intercept, round(loss, 6) as loss, n, round(base_rate, 6) as base_rate from ({found})"


@query("G14", sql=_rounded(K.sql_platt(_P, "p", "y")))
def platt_fit(spark, sf_dir):
    found = K.platt(predictions(spark, sf_dir), "p", "y")
    return found.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("loss", 6).alias("loss"), "n", F.round("base_rate", 6).alias("base_rate"))


@query("G15", sql="select vec_id, label, cast((row_number() over (order by label, vec_id) - 1) % 5 as integer) as fold from embeddings")
def probe_folds(spark, sf_dir):
    return K.stratified(load(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("G15", "Q24")
def probe_train(spark, sf_dir):
    return K.probe_grid(load(spark, sf_dir, "embeddings"))


@query("G4", "R13", sql="select doc_id, source, (floor(n_chars / max(n_chars) over (partition by source)::double * 1e6 + 0.5) / 1e6) as score from documents")
def score_max_normalised(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    best = d.groupBy("source").agg(F.max("n_chars").alias("m"))  # joined back rather than a window, so a large source is no single task
    return d.join(best, "source").select("doc_id", "source", quantised(F.col("n_chars") / F.col("m").cast("double")).alias("score"))

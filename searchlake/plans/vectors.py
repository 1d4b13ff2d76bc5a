"""Vector queries over embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions.dialect import quantised, sql_quantised
from searchlake.operators import retrieval as R
from searchlake.operators import vectors as V
from searchlake.plans.ranking import retrieved
from searchlake.session import load, spread

_E = "select vec_id, list_transform(embedding, lambda x: x::double) as v, label from embeddings"
_PAIRS = f"with e as ({_E}), q as (select vec_id as query_id, v as qv from e where vec_id % 20 = 0)"


def rows(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), "label")


def against(spark, sf_dir, kind, **kept):
    """Every row whose id is divisible by 20 as a query against all other rows."""
    e = rows(spark, sf_dir).select("vec_id", "v")
    return V.block_scores(e, e.where("vec_id % 20 = 0"), kind, **kept)


def _topk(name, score):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return score.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "rank", "vec_id", "score")


@query("R3", "J2", sql=f"{_PAIRS} select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select query_id, vec_id, {sql_quantised('list_inner_product(qv, v)')} as score from q join e on vec_id <> query_id)) where rank <= 10")
def vector_dot_topk(spark, sf_dir):
    return _topk("dot", against(spark, sf_dir, "dot", top=10))


@query("R4", sql=f"{_PAIRS} select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select query_id, vec_id, {sql_quantised('list_cosine_similarity(qv, v)')} as score from q join e on vec_id <> query_id)) where rank <= 10")
def vector_cosine_topk(spark, sf_dir):
    return _topk("cosine", against(spark, sf_dir, "cosine", top=10))


@query("R5", sql=f"with e as ({_E}) select vec_id, {sql_quantised('list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))))')} as total, {sql_quantised('v[1] / sqrt(list_inner_product(v, v))')} as first from e")
def vector_normalize(spark, sf_dir):
    n = rows(spark, sf_dir).select("vec_id", V.normalised(F.col("v")).alias("u"))
    return n.select("vec_id", quantised(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"), quantised(F.get("u", 0)).alias("first"))


@query("R5", sql=f"with e as ({_E}), parts as (select label, i, avg(x) as x from (select label, unnest(v) as x, unnest(range(len(v))) as i from e) group by 1, 2), p as (select label, list(x order by i) as m from parts group by 1) select label, {sql_quantised('list_sum(list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))))')} as total, {sql_quantised('m[1] / sqrt(list_inner_product(m, m))')} as first from p")
def vector_mean_pool(spark, sf_dir):
    """The vectors of every label pooled by their mean and brought to length one, as an encoder pools those of a text's tokens."""
    pooled = V.centroids(rows(spark, sf_dir), "label", "v").select("label", V.normalised(F.col("centroid")).alias("u"))
    return pooled.select("label", quantised(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"), quantised(F.get("u", 0)).alias("first"))


_CENTRE = f"""e as ({_E}), parts as (select label, i, avg(x) as x from (select label, unnest(v) as x, unnest(range(len(v))) as i from e) group by 1, 2),
    c as (select label as centre, list(x order by i) as cv from parts group by 1),
    s as (select vec_id, label, centre, {sql_quantised('list_cosine_similarity(v, cv)')} as s from e cross join c)"""


@query("R6", sql=f"with {_CENTRE} select vec_id, label, centre as predicted, s as score from (select *, row_number() over (partition by vec_id order by s desc, centre) as r from s) where r = 1")
def centroid_classify(spark, sf_dir):
    e = rows(spark, sf_dir)
    c = V.centroids(e, "label", "v").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("cs"))  # one vector a class
    scored = V.bound(F.col("v"), lambda v: F.transform("cs", lambda c: F.struct(quantised(V.cosine(v, c["centroid"])).alias("s"), (-c["label"]).alias("k"))))
    best = e.join(F.broadcast(c), F.lit(True)).select("vec_id", "label", F.array_max(scored).alias("b"))
    return best.select("vec_id", "label", (-F.col("b.k")).alias("predicted"), F.col("b.s").alias("score"))


_SOFTMAX = f"""{_CENTRE}, z as (select vec_id, centre, exp((4 * s - max(4 * s) over (partition by vec_id)) / 1.2) as z from s),
    probs as (select vec_id, centre as label, {sql_quantised("z / sum(z) over (partition by vec_id)")} as p from z)"""


def probe(spark, sf_dir):
    """(vec_id, z): label and probability of every class, by a softmax with a temperature of 1.2 over a linear probe; its weights are four times the class centroids."""
    e = rows(spark, sf_dir)
    c = V.centroids(e, "label", "v").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("cs"))
    logits = V.bound(F.col("v"), lambda v: F.transform("cs", lambda c: 4 * quantised(V.cosine(v, c["centroid"]))))
    probs = e.join(F.broadcast(c), F.lit(True)).select("vec_id", F.arrays_zip(F.transform("cs", lambda c: c["label"]).alias("label"), V.softmax(logits, 1.2).alias("p")).alias("z"))
    return probs.select("vec_id", F.transform("z", lambda z: F.struct(z["label"].alias("label"), quantised(z["p"]).alias("p"))).alias("z"))


@query("Q24", sql=f"with {_SOFTMAX} select vec_id, label, p from probs")
def probe_softmax(spark, sf_dir):
    return probe(spark, sf_dir).select("vec_id", F.explode("z").alias("z")).select("vec_id", "z.label", "z.p")


# the floor is a fixed value; base and slope of the confidence, and the label to fall back to, are our own
_FLOOR, _BASE, _SLOPE, _FALLBACK = 0.55, 0.5, 1.5, 0


@query("Q24", sql=f"""with {_SOFTMAX}, r as (select *, row_number() over (partition by vec_id order by p desc, label) as r from probs),
    t as (select vec_id, max(label) filter (where r = 1) as winner, max(p) filter (where r = 1) - coalesce(max(p) filter (where r = 2), 0) as margin from r group by 1),
    sure as (select *, least(greatest({_BASE} + margin * {_SLOPE}, 0), 1) as confidence from t)
    select vec_id, case when confidence < {_FLOOR} then {_FALLBACK} else winner end as label, winner, {sql_quantised("margin")} as margin, {sql_quantised("confidence")} as confidence from sure""")  # fmt: skip
def probe_confidence(spark, sf_dir):
    """The probe's class with a confidence from the margin of the best two; below the floor the fallback label stands."""
    order = F.array_sort(F.transform("z", lambda z: F.struct((-z["p"]).alias("minus"), z["label"].alias("label"))))
    top = probe(spark, sf_dir).select("vec_id", order.alias("o")).select("vec_id", F.get("o", 0)["label"].alias("winner"), (F.coalesce(F.get("o", 1)["minus"], F.lit(0.0)) - F.get("o", 0)["minus"]).alias("margin"))
    sure = top.withColumn("confidence", F.least(F.greatest(_BASE + F.col("margin") * _SLOPE, F.lit(0.0)), F.lit(1.0)))
    label = F.when(F.col("confidence") < _FLOOR, F.lit(_FALLBACK).cast("int")).otherwise(F.col("winner"))
    return sure.select("vec_id", label.alias("label"), "winner", quantised(F.col("margin")).alias("margin"), quantised(F.col("confidence")).alias("confidence"))


_GATE = f"""{_PAIRS}, s as (select query_id, vec_id, {sql_quantised('list_inner_product(qv, v)')} as sim from q join e on vec_id <> query_id),
    g as (select *, max(sim) over (partition by query_id) as best, count(*) over (partition by query_id) as n from s)"""


@query("F15", "G2", sql=f"{_GATE} select query_id, vec_id, sim from g where sim >= {R.SEMANTIC_EACH} and best >= {R.SEMANTIC_MIN} and n >= {R.SEMANTIC_ROWS}")
def semantic_gate(spark, sf_dir):
    s = against(spark, sf_dir, "dot", least=R.SEMANTIC_EACH).withColumnRenamed("score", "sim")
    copies = rows(spark, sf_dir).where("vec_id is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    total = copies.agg(F.sum("n")).first()[0] or 0  # one number; a query meets all rows but those of its own id
    # a best score that opens the gate is among the rows that pass
    best = s.groupBy("query_id").agg(F.max("sim").alias("best")).where(F.col("best") >= R.SEMANTIC_MIN)
    open_ = best.join(copies.withColumnRenamed("vec_id", "query_id"), "query_id").where(F.lit(total) - F.col("n") >= R.SEMANTIC_ROWS).select("query_id")
    return s.join(open_, "query_id", "left_semi")


@query("R7", "J4", "G3", sql=f"""with {R.sql_search()}, {R.SQL_RANKED}, e as ({_E}),
    sem as (select query_id, doc_id, row_number() over (partition by query_id order by sim desc, doc_id) as rank from (select q.vec_id as query_id, e.vec_id as doc_id, {sql_quantised('list_inner_product(q.v, e.v)')} as sim
        from e q join e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0) where sim >= 0.3),
    lex as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from floored)
    select query_id, doc_id, {sql_quantised("coalesce(1 / (60.0 + lex.rank), 0)::double + coalesce(1 / (60.0 + sem.rank), 0)::double")} as rrf, lex.rank is not null as lexical from lex full join sem using (query_id, doc_id)""")  # fmt: skip
def hybrid_rrf(spark, sf_dir):
    """Lexical and semantic lists fused; the semantic one only adds."""
    lexical = retrieved(spark, sf_dir).select("query_id", "doc_id", F.lit(None).cast("double").alias("sim"), "rank")
    s = against(spark, sf_dir, "dot", least=0.3).select("query_id", F.col("vec_id").alias("doc_id"), F.col("score").alias("sim"), F.lit(None).cast("int").alias("rank"))
    # ranks and sums by the same key: the semantic pairs are shuffled once
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("sim"), "doc_id")
    rows = lexical.unionByName(s).withColumn("lexical", F.col("rank").isNotNull()).withColumn("rank", F.coalesce("rank", F.row_number().over(order)))
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (R.RRF_K + F.col("rank"))).alias("rrf"), F.max("lexical").alias("lexical"))
    return fused.select("query_id", "doc_id", quantised(F.col("rrf")).alias("rrf"), "lexical")


@query("S17", "O6", sql="select vec_id, len(embedding)::integer as width, cast(embedding[1] as double) as first from embeddings")
def embedding_lookup(spark, sf_dir):
    """The vector of every key of the table, joined as any list of keys would be."""
    e = load(spark, sf_dir, "embeddings")
    keys = e.select("vec_id").distinct()
    return e.join(keys, "vec_id", "left_semi").select("vec_id", F.size("embedding").alias("width"), F.get("embedding", 0).cast("double").alias("first"))

"""Accuracy, AUC, calibration error, spread, Platt scaling and a linear probe."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlake.functions.dialect import quantised
from searchlake.operators.sequences import numbered


def counted(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Rows per distinct score: what the statistics below need."""
    return rows.groupBy(F.col(score).alias("p")).agg(F.count(F.lit(1)).alias("k"), F.sum(label).alias("pos"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Share of pairs in order, ties half: running counts over distinct scores."""
    c = counted(rows, score, label)
    below = F.coalesce(F.sum(F.col("k") - F.col("pos")).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.col("pos") * (below + (F.col("k") - F.col("pos")) / 2.0)
    out = c.withColumn("part", part).agg(F.sum("part").alias("s"), F.sum("pos").alias("np"), F.sum(F.col("k") - F.col("pos")).alias("nn"))
    return out.select(quantised(F.col("s") / (F.col("np") * F.col("nn"))).alias("auc"), F.col("np").cast("long").alias("positives"), F.col("nn").cast("long").alias("negatives"))


def ece(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Expected calibration error over ten bins of equal width."""
    bins = rows.groupBy(F.least(F.lit(9), F.floor(10 * F.col(score))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mp"), F.avg(label).alias("my"))
    return bins.agg(quantised(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"), F.count(F.lit(1)).alias("bins"))


def spread(rows: DataFrame, score: str) -> DataFrame:
    """Values at the indices n/20, n/2 and 19n/20 of the sorted scores, from counts of distinct ones."""
    c = rows.groupBy(F.col(score).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("p"))
    c = c.withColumn("upto", upto).crossJoin(c.agg(F.sum("k").alias("n")))  # one row
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("p")))
    n = F.col("n")
    return c.agg(at(F.floor(n / 20)).alias("p05"), at(F.floor(n / 2)).alias("p50"), at(F.floor(n * 19 / 20)).alias("p95"))


#: Log-odds and probabilities stay this far from the ends; a search gains this much or goes on with half the step, down to the last one.
CLIP, EPS, GAIN, FIRST_STEP, LAST_STEP, ROUNDS = 1e-3, 1e-12, 1e-12, 2.0, 1e-7, 400


def binned(rows: DataFrame, score: str, label: str) -> list[tuple[float, int, int]]:
    """(log-odds, rows, positives) of scores rounded to three places: 999 at most."""
    near = F.round(F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP)), 3)
    found = counted(rows.select(near.alias("p"), F.col(label).alias("y")), "p", "y").orderBy("p").collect()
    return [(math.log(r["p"] / (1 - r["p"])), r["k"], r["pos"]) for r in found]


def descend(data: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Slope, intercept and mean negative log-likelihood of a logistic curve by coordinate descent: each step is tried both ways for
    one, then for the other, and halved when none of the four gains."""
    total = sum(k for _, k, _ in data)

    def loss(a: float, b: float) -> float:
        out = 0.0
        for x, k, pos in data:
            p = 1 / (1 + math.exp(-max(-700.0, a * x + b)))
            out -= pos * math.log(max(p, EPS)) + (k - pos) * math.log(max(1 - p, EPS))
        return out / total

    at, best, step = [1.0, 0.0], loss(1.0, 0.0), FIRST_STEP
    for _ in range(ROUNDS):
        before = best
        for which in (0, 1):
            for way in (-step, step):
                tried = list(at)
                tried[which] += way
                value = loss(*tried)
                if value < best - GAIN:
                    at, best = tried, value
        if best == before:
            step /= 2
            if step < LAST_STEP:
                break
    return at[0], at[1], best


def platt(rows: DataFrame, score: str, label: str) -> DataFrame:
    """slope, intercept, loss, n, base_rate of a logistic curve over the log-odds; the search runs on at most 999 counts."""
    data = binned(rows, score, label)
    n = sum(k for _, k, _ in data)
    kind = "slope double, intercept double, loss double, n long, base_rate double"
    if not n:
        return rows.sparkSession.createDataFrame([], kind)
    return rows.sparkSession.createDataFrame([(*descend(data), n, sum(p for *_, p in data) / n)], kind)


def sql_platt(predictions: str, score: str, label: str) -> str:
    """DuckDB: ``predictions`` are common table expressions; each row of the search is one trial."""
    near = f"round(least(greatest({score}, {CLIP}), {1 - CLIP}), 3)"
    return f"""{predictions.replace("with ", "with recursive ", 1)},
    c as (select {near} as p, count(*)::double as k, sum({label})::double as pos from p group by 1),
    d as (select list(struct_pack(x := ln(p / (1 - p)), k := k, pos := pos) order by p) as d, sum(k) as n, sum(pos) as s from c),
    search as (select d, n, s, 1.0::double as a, 0.0::double as b, {FIRST_STEP}::double as step, 0 as trial, false as gained, 0 as rounds, {_sql_loss('1.0', '0.0')} as best from d
        union all select d, n, s, case when better then ta else a end, case when better then tb else b end, case when trial = 3 and not (gained or better) then step / 2 else step end,
            (trial + 1) % 4, case when trial = 3 then false else gained or better end, rounds + (trial = 3)::int, case when better then v else best end
        from (select *, v < best - {GAIN} as better from (select *, {_sql_loss('ta', 'tb')} as v from (select *, a + case trial when 0 then -step when 1 then step else 0 end as ta, b + case trial when 2 then -step when 3 then step else 0 end as tb
            from search where rounds < {ROUNDS} and step >= {LAST_STEP}))))
    select a as slope, b as intercept, best as loss, n::bigint as n, s / n as base_rate from search order by rounds desc, trial desc limit 1"""


def _sql_loss(a: str, b: str) -> str:
    p = f"(1 / (1 + exp(-greatest(-700, {a} * e.x + {b}))))"
    return f"(-list_sum(list_transform(d, lambda e: e.pos * ln(greatest({p}, {EPS})) + (e.k - e.pos) * ln(greatest(1 - {p}, {EPS})))) / n)"


def stratified(rows: DataFrame, id_col: str, label: str, folds: int = 5) -> DataFrame:
    """The rows with ``fold``: dealt in turn in the order of label and id, so every fold holds each class within one row."""
    return numbered(rows.withColumn("_at", F.col(label).cast("long") * F.lit(1 << 40) + F.col(id_col)), "_at", [id_col], "_place").withColumn("fold", (F.col("_place") % folds).cast("int")).drop("_at", "_place")


def probe_grid(embeddings: DataFrame, grid: tuple[float, ...] = (0.1, 1.0, 10.0), folds: int = 5) -> DataFrame:
    """c, accuracy (mean over the folds), spread (their standard deviation), chosen: multinomial logistic regression over a grid of inverse penalties."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = stratified(embeddings.select("vec_id", "embedding", "label"), "vec_id", "label", folds)
    rows = rows.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"), "fold").cache()
    n = rows.count()
    model = LogisticRegression(maxIter=20, family="multinomial")
    penalties = ParamGridBuilder().addGrid(model.regParam, [1 / (c * max(n, 1)) for c in grid]).build()
    search = CrossValidator(estimator=model, estimatorParamMaps=penalties, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), foldCol="fold", numFolds=folds, parallelism=len(grid))
    found = search.fit(rows)
    rows.unpersist()
    best = max(range(len(grid)), key=lambda i: (found.avgMetrics[i], -grid[i]))
    out = [(c, float(a), float(d), i == best) for i, (c, a, d) in enumerate(zip(grid, found.avgMetrics, found.stdMetrics))]
    return embeddings.sparkSession.createDataFrame(out, "c double, accuracy double, spread double, chosen boolean")

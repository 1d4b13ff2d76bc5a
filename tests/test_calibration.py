"""Platt scaling, stratified folds, the probe's grid, names and abbreviations."""

import math

from pyspark.sql import functions as F

from searchlake.catalog import all_queries
from searchlake.operators import calibrate as K
from searchlake.plans import understanding as U


def loss(data, a, b):
    total = sum(k for _, k, _ in data)
    out = 0.0
    for x, k, pos in data:
        p = 1 / (1 + math.exp(-(a * x + b)))
        out -= pos * math.log(max(p, K.EPS)) + (k - pos) * math.log(max(1 - p, K.EPS))
    return out / total


def newton(data, rounds=60):
    a, b = 1.0, 0.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, k, pos in data:
            q = 1 / (1 + math.exp(-(a * x + b)))
            d, w = k * q - pos, k * q * (1 - q)
            g0, g1, h00, h01, h11 = g0 + d * x, g1 + d, h00 + w * x * x, h01 + w * x, h11 + w
        det = h00 * h11 - h01 * h01
        a, b = a - (h11 * g0 - h01 * g1) / det, b - (h00 * g1 - h01 * g0) / det
    return a, b


def test_descent_finds_the_minimum(spark):
    rows = [(0.05 + 0.9 * (i * 37 % 100) / 100, int((i * 37 % 100) + 30 * ((i * 7919) % 11) / 10 > 60)) for i in range(2000)]
    df = spark.createDataFrame(rows + [(0.0, 0), (1.0, 1), (1.5, 1)], "p double, y int")
    data = K.binned(df, "p", "y")
    assert len(data) <= 999 and sum(k for _, k, _ in data) == 2003
    a, b, best = K.descend(data)
    x, y = newton(data)
    assert abs(a - x) < 1e-4 and abs(b - y) < 1e-4 and abs(best - loss(data, a, b)) < 1e-9 and best <= loss(data, x, y) + 1e-9
    got = K.platt(df, "p", "y").first()
    assert (got.slope, got.intercept, got.n) == (a, b, 2003)
    assert K.platt(df.where("false"), "p", "y").count() == 0


def test_every_fold_holds_each_class_within_one_row(spark):
    rows = [(i, 0 if i % 3 else 1 + i % 4) for i in range(997)]  # two thirds of one class
    got = K.stratified(spark.createDataFrame(rows, "vec_id long, label int").repartition(5), "vec_id", "label").groupBy("label", "fold").count().collect()
    for label in {r.label for r in got}:
        counts = [r["count"] for r in got if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_the_grid_reports_its_choice(spark):
    rows = [(i, [float(i % 2) + 0.01 * (i * 7 % 13), 0.1 * (i * 11 % 17)], i % 2) for i in range(120)]
    got = K.probe_grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), grid=(0.01, 1.0), folds=3).collect()
    assert [r.c for r in got] == [0.01, 1.0] and sum(r.chosen for r in got) == 1
    assert max(r.accuracy for r in got) == next(r.accuracy for r in got if r.chosen) > 0.9


def test_abbreviations_by_shape(spark):
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in ("hdmi", "banana", "xml", "x", "", "k8s", "strengths", "io", None)], "w string").select("w", U.shortened(F.col("w")).alias("s")).collect()}
    assert abs(got["xml"] - (0.5 + 0.3 + 0.2 / 3)) < 1e-12 and abs(got["hdmi"] - (0.5 * (1 - 0.25 / 0.45) + 0.3 * 0.85 + 0.2 / 4)) < 1e-12
    assert abs(got["banana"] - 0.3 * 0.3) < 1e-12 and abs(got["io"] - 0.3 * 0.9) < 1e-12
    assert got["x"] == got[""] == got["k8s"] == got["strengths"] == 0 and not got[None]


def test_rare_letters_look_like_names(spark, tmp_path):
    spark.createDataFrame([(1, "the tin and the net " * 40 + "zyx")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "the zyx net"), (2, 0, "user", "Kubernetes ok"), (3, 0, "user", "the net"), (4, 0, "user", "4k qqq"), (5, 0, "user", "")], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.word: r for r in all_queries()["entityness"](spark, str(tmp_path)).collect()}
    assert got["zyx"].entityness > 0.9 > got["the"].entityness and got["qqq"].rare and not got["zyx"].rare and got["4k"].entityness == 0.3
    named = {r.conv_id: r.named for r in all_queries()["brand_queries"](spark, str(tmp_path)).collect() if r.conv_id > 0}
    assert named[1] and named[2] and named[4] and not named[5]

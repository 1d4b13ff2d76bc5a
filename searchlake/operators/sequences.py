"""Ordered folds per key: gates, moving averages, generations, as-of joins.

A fold over the last accepted value is no window function. The rows of a key are folded as a sorted array, with the higher-order
functions; keys are users, whose events are few. For keys without such a bound the streaming versions keep one state value instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlake.functions.dialect import quantised


def gate(rows: DataFrame, key: str, time: str, row_id: str, delay: int) -> DataFrame:
    """(key, row id, accepted): a row passes if the last that passed is at least ``delay`` back."""
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(row_id).alias("i")))).alias("v"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<i:long,ok:boolean>>").alias("out"))

    def step(a, x):
        ok = a["last"].isNull() | (x["t"] - a["last"] >= delay)
        return F.struct(F.when(ok, x["t"]).otherwise(a["last"]).alias("last"), F.concat(a["out"], F.array(F.struct(x["i"].alias("i"), ok.alias("ok")))).alias("out"))

    out = ordered.select(key, F.explode(F.aggregate("v", start, step, lambda a: a["out"])).alias("e"))
    return out.select(key, F.col("e.i").alias(row_id), F.col("e.ok").alias("accepted"))


def ewma(rows: DataFrame, key: str, value: str, order: list[str], keep: float = 0.7) -> DataFrame:
    """(key, n, ewma): the first value starts, each later one counts ``1 - keep``."""
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("x")))).alias("v"))
    folded = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", 0)["x"], lambda a, e: keep * a + (1 - keep) * e["x"])
    return ordered.select(key, F.size("v").cast("long").alias("n"), quantised(folded).alias("ewma"))


def numbered(rows: DataFrame, by: str, ties: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """A running number from 0 over all rows, by a number and then by ``ties``: ranks within ranges of the number, and the totals of the ranges before.

    The ranges are cut at quantiles, so no task sorts all rows; rows with the same number share one.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    held = rows.withColumn("_r", F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(by))) if bounds else F.lit(0))
    before = F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    totals = held.groupBy("_r").agg(F.count(F.lit(1)).alias("n")).select("_r", F.coalesce(before, F.lit(0)).alias("_t"))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy(by, *ties)) - 1
    return held.withColumn("_i", rank).join(F.broadcast(totals), "_r").withColumn(out, (F.col("_i") + F.col("_t")).cast("long")).drop("_r", "_i", "_t")


def generations(first: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Generation of every key by order of first sight; only the two newest are kept."""
    half = cap // 2
    ranked = numbered(first, order, [key], "i").withColumn("generation", F.floor(F.col("i") / half))
    newest = ranked.agg(F.max("generation").alias("g")).first()["g"]
    return ranked.select(key, "generation", (F.col("generation") >= F.lit((newest or 0) - 1)).alias("kept"))


def as_of(left: DataFrame, left_key: str, left_at: str, right: DataFrame, right_key: str, right_at: str) -> DataFrame:
    """Latest right row of the key at or before each left row: both sides in one ordered pass."""
    a = left.select(F.col(left_key).alias("k"), F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("r"))
    b = right.select(F.col(right_key).alias("k"), F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(right_at).cast("long").alias("r"))
    w = Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("last_order", F.last("r", ignorenulls=True).over(w))
    return both.where("side = 1").select(F.col("at").alias(left_at), "last_order")

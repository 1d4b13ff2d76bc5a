"""Batch twins of the sequential and streaming operators, on the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from searchlake.catalog import query
from searchlake.functions.dialect import sql_quantised
from searchlake.operators import sequences as Q
from searchlake.session import load


def events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


@query("W8", "X8", sql="select event_id, n::bigint as n, n >= 3 as limited from (select event_id, count(*) over (partition by user_id % 50 order by epoch_us(ts) range between 300000000 preceding and current row) as n from events where event_type = 'error')")
def rate_signal_sliding(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'error'").withColumn("k", F.col("user_id") % 50)
    w = Window.partitionBy("k").orderBy("us").rangeBetween(-300_000_000, 0)
    return e.withColumn("n", F.count(F.lit(1)).over(w)).select("event_id", "n", (F.col("n") >= 3).alias("limited"))


@query(
    "W7", "X2",
    sql="""with recursive e as (select user_id, epoch_us(ts) as us, event_id, row_number() over (partition by user_id order by epoch_us(ts), event_id) as r from events where event_type = 'view'),
    g as (select user_id, r, event_id, us as last, true as accepted from e where r = 1
        union all select e.user_id, e.r, e.event_id, case when e.us - g.last >= 86400000000 then e.us else g.last end, e.us - g.last >= 86400000000 from g join e on e.user_id = g.user_id and e.r = g.r + 1)
    select user_id, event_id, accepted from g""",
)
def domain_gate(spark, sf_dir):
    """Accepted only if the last accepted one of its key is far enough back."""
    return Q.gate(events(spark, sf_dir).where("event_type = 'view'"), "user_id", "us", "event_id", 86_400_000_000)


@query("W6", "X6", sql=f"""with v as (select user_id, list(value order by epoch_us(ts), event_id) as v from events group by 1)
    select user_id, len(v)::bigint as n, {sql_quantised("list_reduce(v, lambda a, x: 0.7 * a + 0.3 * x)")} as ewma from v""")  # fmt: skip
def latency_ewma(spark, sf_dir):
    return Q.ewma(events(spark, sf_dir), "user_id", "value", ["us", "event_id"])


@query("X7", "O10", sql="""with e as (select user_id, epoch_us(ts) // 1000000 as s, event_id from events),
    d as (select *, s - lag(s) over (partition by user_id order by s, event_id) as gap from e) select user_id, count(*) filter (where gap <= 3600)::bigint as hits, count(*)::bigint as n from d group by 1""")  # fmt: skip
def ttl_cache_hits(spark, sf_dir):
    """Requests that come within the lifetime after the last one of their key."""
    e = events(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1_000_000))
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.count_if(F.col("gap") <= 3600).alias("hits"), F.count(F.lit(1)).alias("n"))


@query("X3", sql="with f as (select user_id, min(event_id) as first from events group by 1), r as (select *, row_number() over (order by first) - 1 as i from f) select user_id, (i // 20)::bigint as generation, i // 20 >= (select max(i) // 20 - 1 from r) as kept from r")
def seen_generations(spark, sf_dir):
    """Generations of first sight of half the cap each; the two newest are remembered."""
    first = events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("first"))
    return Q.generations(first, "user_id", "first", 40)


@query("X1", "S19", "S8", sql="select epoch_us(ts) // 86400000000 as batch, count(*)::bigint as n, least(count(*), 20)::bigint as first_flush from events group by 1")
def micro_batches(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.floor(F.col("us") / 86_400_000_000).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("first_flush", F.least("n", F.lit(20).cast("long")))


@query("X6", sql="""with b as (select event_type, epoch_us(ts) // 86400000000 as day, avg(value) / 1000 as spd from events group by 1, 2)
    select event_type, day, case when spd >= 1 / 6.0 then -2 when spd <= 1 / 15.0 then 2 else 0 end as step from b""")  # fmt: skip
def concurrency_steps(spark, sf_dir):
    b = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg((F.avg("value") / 1000).alias("spd"))
    return b.select("event_type", "day", F.when(F.col("spd") >= 1 / 6.0, -2).when(F.col("spd") <= 1 / 15.0, 2).otherwise(0).alias("step"))


# extensions beyond the inventory's own operators: generic relational coverage
@query("J17", sql="select e.event_id, max(o.o_orderkey) as last_order from events e join orders o on o.o_custkey = e.user_id and o.o_orderkey <= e.event_id group by 1")
def ext_as_of_join(spark, sf_dir):
    return Q.as_of(events(spark, sf_dir), "user_id", "event_id", load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").where("last_order is not null")


@query("G22", sql="select l_returnflag, l_linestatus, grouping(l_returnflag)::integer as g, count(*)::bigint as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count(F.lit(1)).alias("n"))


@query("W11", sql="select event_id, lag(event_id) over w as previous, ntile(4) over w::integer as quarter from events window w as (partition by user_id order by event_id)")
def ext_analytic_functions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return load(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("previous"), F.ntile(4).over(w).alias("quarter"))


@query("X1", sql="select event_type, (epoch_us(ts) // 3600000000) as hour, count(*)::bigint as n from events group by 1, 2")
def ext_tumbling_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.count(F.lit(1)).alias("n"))

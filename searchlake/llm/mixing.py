"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every listed source is a stream with a whole-number weight; all other sources, and rows without one,
share one more stream. The j-th block of a stream of weight w (of W in all) is released at slot
floor((j-1)W/w) and due at ceil(jW/w). Earliest deadline first fills the W slots of a cycle; the same
cycle repeats, so at any slot a stream's blocks differ from its share by less than one block. When a stream
has run out, the others go on in the same order: no row is dropped, capped or repeated.

Within a stream rows follow a hash of their id and source. Rows of one hash are counted, not ranked one by one: a running total over
buckets of the hash gives each group its first place, and its rows take the next ones. Groups beyond ``bucket_rows`` (a
missing id, say) are written out in pieces of that size or, if whole rows are carried along, placed by a second hash of all their
columns in the same way, and only rows that are equal in all columns are written out in pieces. So neither a source with a third
of all rows nor an id or a row that often meets in one task.

Defined results: a null id or source counts as an empty one for the hash and comes first among equal hashes; equal rows take neighbouring
positions. Streams without rows are skipped. An empty table gives no rows. Only the id and source columns are read, unless rows
are to be carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch

#: Target weights of the sources, in hundredths; OTHER is for all sources that are not listed.
WEIGHTS = {"src0": 16, **{f"src{i}": 6 for i in range(1, 10)}}
OTHER = 30
BLOCK = 64
_HASH_BITS = 60
RUN_BITS = 10


def stream_of(source: str, names: list[str]) -> Column:
    found = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        found = F.when(F.col(source) == name, i).otherwise(found)
    return found.cast("int")


def schedule(spark, weights: list[int]) -> DataFrame:
    """One row per slot of a cycle: slot, stream, k (which of the stream's blocks), before (blocks of every stream in earlier slots)."""
    total, w = sum(weights), "array({})".format(", ".join(f"{x}L" for x in weights))
    pick = f"""array_min(transform(
        filter(sequence(0, {len(weights) - 1}), s -> a.done[s] < {w}[s] and (a.done[s] * {total}L) div {w}[s] <= t),
        s -> named_struct('due', -((-(a.done[s] + 1) * {total}L) div {w}[s]) + if(((a.done[s] + 1) * {total}L) % {w}[s] = 0, 0L, 1L), 's', s))).s"""
    start = f"named_struct('done', transform({w}, x -> 0L), 'rows', cast(array() as array<struct<slot:bigint,stream:int,k:bigint,before:array<bigint>>>))"
    step = f"""transform(array({pick}), p -> named_struct(
        'done', transform(a.done, (d, i) -> d + if(i = p, 1L, 0L)),
        'rows', concat(a.rows, array(named_struct('slot', t, 'stream', p, 'k', a.done[p], 'before', a.done)))))[0]"""
    made = f"aggregate(sequence(0L, {total - 1}L), {start}, (a, t) -> {step}, a -> a.rows)"
    return spark.range(1).select(F.inline(F.expr(made)))


def _first_places(groups: DataFrame, keys: list[str], order: list[str], bucket_rows: int, total: int) -> DataFrame:
    """``first``: rows of the same keys before each group, by running totals within buckets of the hash ``h``, runs of buckets, and all runs."""
    bits = max(0, (total // bucket_rows).bit_length())
    groups = groups.withColumn("bucket", F.shiftright("h", _HASH_BITS - bits) if bits else F.lit(0).cast("long"))
    sizes = groups.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumn("run", F.shiftright("bucket", RUN_BITS))
    earlier = (Window.unboundedPreceding, -1)
    runs = sizes.groupBy(*keys, "run").agg(F.sum("n").alias("t"))
    runs = runs.select(*keys, "run", F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("run").rowsBetween(*earlier)), F.lit(0)).alias("above"))
    sizes = sizes.withColumn("within", F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "run").orderBy("bucket").rowsBetween(*earlier)), F.lit(0)))
    sizes = sizes.join(runs, [*keys, "run"]).select(*keys, "bucket", (F.col("within") + F.col("above")).alias("base"))
    local = Window.partitionBy(*keys, "bucket").orderBy("h", *order).rowsBetween(*earlier)
    placed = groups.withColumn("before", F.coalesce(F.sum("n").over(local), F.lit(0))).join(sizes, [*keys, "bucket"])
    return placed.withColumn("first", F.col("before") + F.col("base")).drop("before", "base", "bucket")


def _whole_rows(rows: DataFrame, keys: list[str], bucket_rows: int, total: int) -> DataFrame:
    """Rows with their places ``at`` among those of the same keys: few of a hash are numbered where they meet their group's first place."""
    groups = _first_places(rows.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n")), keys, [], bucket_rows, total)
    groups = Scratch(rows.sparkSession).save(groups, "places")  # a few numbers for every hash; the rows themselves move once
    few, many = groups.where(F.col("n") <= bucket_rows).drop("n"), groups.where(F.col("n") > bucket_rows).drop("n")
    number = F.row_number().over(Window.partitionBy(*keys, "h").orderBy("doc_id", "source"))
    out = rows.join(few, [*keys, "h"]).withColumn("at", F.col("first") + number - 1).drop("first", "h")
    if many.isEmpty():
        return out
    left = rows.join(many.select(*keys, "h"), [*keys, "h"], "left_semi")
    if "name" not in keys:
        left = left.withColumnRenamed("h", "name").withColumn("h", F.xxhash64("row").bitwiseAND((1 << _HASH_BITS) - 1))
        inner = _whole_rows(left, [*keys, "name"], bucket_rows, total)
        placed = inner.join(many.withColumnRenamed("h", "name"), [*keys, "name"]).withColumn("at", F.col("at") + F.col("first")).drop("first", "name")
        return out.unionByName(placed)
    # so many rows of one hash of all columns are equal rows: kept once and counted before they move
    equal = left.groupBy(*keys, "h", "doc_id", "source", "row").agg(F.count(F.lit(1)).alias("n"))
    others = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "h").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = equal.withColumn("others", others).join(many, [*keys, "h"]).withColumn("first", F.col("first") + F.col("others")).drop("others")
    return out.unionByName(_copies(equal, bucket_rows).drop("n", "first", "h"))


def _copies(groups: DataFrame, most: int) -> DataFrame:
    """One row, with its place ``at``, for each of the ``n`` rows of a group; groups of over ``most`` are dealt out in pieces first."""
    step = F.lit(most).cast("long")
    small = groups.where(F.col("n") <= most).withColumn("at", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    pieces = groups.where(F.col("n") > most).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
    pieces = pieces.repartition(F.col("h"), F.col("piece"))
    large = pieces.withColumn("at", F.explode(F.sequence(F.col("first") + F.col("piece"), F.col("first") + F.least(F.col("piece") + step, F.col("n")) - 1))).drop("piece")
    return small.unionByName(large)


def mix(docs: DataFrame, weights: dict[str, int] | None = None, other: int = OTHER, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, carry: bool = False, bucket_rows: int = 4_000) -> DataFrame:
    """doc_id, source, stream, block, slot, position (dense, from 0); with ``carry`` also the whole row as a struct ``row``."""
    spark = docs.sparkSession
    weights = WEIGHTS if weights is None else weights
    names, each = list(weights), [*weights.values(), other]
    if min(each) < 1:
        raise ValueError("weights are whole numbers from 1")
    cycle = sum(each)
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *extra)
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("source", F.lit("")))
    rows = rows.withColumn("stream", stream_of("source", names)).withColumn("h", F.conv(F.substring(F.md5(named), 1, _HASH_BITS // 4), 16, 10).cast("long"))
    counts = {r["stream"]: r["n"] for r in docs.select(F.col(source_col).alias("source")).select(stream_of("source", names).alias("stream")).groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a stream
    total = sum(counts.values())
    if carry:
        ranked = _whole_rows(rows, ["stream"], bucket_rows, total)
    else:
        groups = rows.groupBy("stream", "h", "doc_id", "source").agg(F.count(F.lit(1)).alias("n"))
        ranked = _copies(_first_places(groups, ["stream"], ["doc_id", "source"], bucket_rows, total), bucket_rows)
    weight = F.element_at(F.lit(each), F.col("stream") + 1).cast("long")
    ranked = ranked.withColumn("block", F.floor(F.col("at") / block)).withColumn("turn", F.floor(F.col("block") / weight)).withColumn("k", F.col("block") % weight)
    slots = schedule(spark, each).select("stream", "k", F.col("slot").alias("s"), "before")
    placed = ranked.join(F.broadcast(slots), ["stream", "k"])  # as many rows as the weights' sum
    ahead = F.lit(0).cast("long")
    for i, w in enumerate(each):
        ahead = ahead + F.least(F.lit(counts.get(i, 0)).cast("long"), (F.col("turn") * w + F.col("before")[i]) * block)
    return placed.select(
        "doc_id", "source", "stream", F.col("block").cast("long").alias("block"), (F.col("turn") * cycle + F.col("s")).cast("long").alias("slot"),
        (ahead + F.col("at") % block).cast("long").alias("position"), *(["row"] if carry else []),
    )


def plan_rows(weights: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """The same schedule in plain Python, for the DuckDB statement and the tests."""
    total, done, rows = sum(weights), [0] * len(weights), []
    for t in range(total):
        _, s = min((-((-(done[s] + 1) * total) // w), s) for s, w in enumerate(weights) if done[s] < w and done[s] * total // w <= t)
        rows.append((t, s, done[s], list(done)))
        done[s] += 1
    return rows


def oracle(weights: dict[str, int] | None = None, other: int = OTHER, block: int = BLOCK, table: str = "documents") -> str:
    """DuckDB SQL for :func:`mix` over a table."""
    weights = WEIGHTS if weights is None else weights
    each = [*weights.values(), other]
    cases = " ".join(f"when source = '{n}' then {i}" for i, n in enumerate(weights))
    values = ", ".join(f"({t}, {s}, {k}, {b})" for t, s, k, b in plan_rows(each))
    return f"""
with slots(s, stream, k, before) as (values {values}),
w(u, weight) as (values {", ".join(f"({i}, {x})" for i, x in enumerate(each))}),
d as (select doc_id, source, case {cases} else {len(weights)} end as stream,
        cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(source, '')), 1, 15) as bigint) as h from {table}),
totals as (select stream as u, count(*) as n from d group by 1),
r as (select d.*, row_number() over (partition by stream order by h, doc_id nulls first, source nulls first) - 1 as pos from d),
b as (select r.*, pos // {block} as block, (pos // {block}) // weight as turn, (pos // {block}) % weight as k from r join w on w.u = r.stream),
p as (select b.*, slots.s, slots.before from b join slots on slots.stream = b.stream and slots.k = b.k)
select doc_id, source, cast(stream as integer) as stream, cast(block as bigint) as block, cast(turn * {sum(each)} + s as bigint) as slot,
    cast((select sum(least(t.n, (turn * w.weight + before[w.u + 1]) * {block})) from totals t join w on w.u = t.u) + pos % {block} as bigint) as position
from p
"""

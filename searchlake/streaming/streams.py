"""Structured Streaming versions of the crawl loop, rate signals, gates and caches.

All state is bounded by a watermark or by one value per key with a time-out. Checkpoints make every sink restartable.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16, schema: str = EVENTS) -> DataFrame:
    """A folder of Parquet files as a stream; the rate limit is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def rate_signal(events: DataFrame, size: str = "5 minutes", step: str = "1 minute", limit: int = 3, late: str = "10 minutes") -> DataFrame:
    """Sliding counts of errors, and whether a window reaches the limit."""
    errors = events.where("event_type = 'error'").withWatermark("ts", late)
    counted = errors.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n", (F.col("n") >= limit).alias("limited"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark's span; older keys are forgotten and may come again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def gate(events: DataFrame, delay_us: int, idle_ms: int = 3_600_000) -> DataFrame:
    """user_id, event_id, accepted: one value of state per key, dropped when the key is idle. Rows of a trigger are taken in order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        taken = []
        for us in rows["us"]:
            ok = last is None or us - last >= delay_us
            last = int(us) if ok else last
            taken.append(ok)
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": taken})

    keyed = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, accepted boolean", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def moving_average(events: DataFrame, keep: float = 0.7) -> DataFrame:
    """user_id, n, ewma after each trigger: the state is the count and the average."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        for value in pd.concat(list(frames)).sort_values(["us", "event_id"])["value"]:
            average = float(value) if n == 0 else keep * average + (1 - keep) * float(value)
            n += 1
        state.update((n, average))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ewma": [average]})

    keyed = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"), "value")
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, ewma double", "n long, average double", "update", GroupStateTimeout.NoTimeout)


#: Entries that the frontier holds, and the share of it from which pages give no more of them.
FRONTIER_MOST, FRONTIER_FULL = 50_000, 0.8


def before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """Rows that batches before this one have written; none if there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < number).drop("batch")


def crawl_loop(spark: SparkSession, landing: str, index: str, frontier: str, checkpoint: str, cap: int = 6500, seen: str | None = None, most: int = FRONTIER_MOST):
    """Pages that land in a folder go through extraction and the quality gate into the index; their new links go to the frontier folder.

    Structured Streaming has no cycles, so the frontier folder is what the fetcher reads next. Every batch writes to its own
    folders by number and reads those of the batches before it, so a batch that is run again after a failure replaces what it wrote
    with the same. A link is new if no batch has fetched its page and none has put it into the frontier; from
    ``FRONTIER_FULL`` of ``most`` entries that wait to be fetched, pages give no more.
    """
    from searchlake.functions import text as T
    from searchlake.functions import url as U
    from searchlake.operators import ingest

    seen = seen or f"{frontier}-seen"

    def write(batch: DataFrame, number: int) -> None:
        rows = ingest.extract(batch, cap).withColumn("m", T.measures(F.col("content")))
        worthy = rows.where(T.indexworthy(F.col("title"), F.col("content"), F.col("m")))
        worthy = worthy.select("url", "title", "content", F.col("page_id").alias("ts"), U.authority(F.col("url")).alias("authority"))
        worthy.write.mode("overwrite").parquet(f"{index}/batch={number}")
        fetched = batch.select(U.crawl_key(F.col("url")).alias("k")).where("k is not null").distinct()
        fetched.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        fetched = before(spark, seen, number + 1, "k string")
        queued = before(spark, frontier, number, "url string, priority double, source string, found_on long").select(F.col("url").alias("k"))
        waiting = queued.join(fetched, "k", "left_anti").count()
        links = ingest.page_links(batch) if waiting < FRONTIER_FULL * most else spark.createDataFrame([], "page_id long, link string, pos int")
        ingest.discover(links, fetched.unionByName(queued)).write.mode("overwrite").parquet(f"{frontier}/batch={number}")

    pages = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 4).parquet(landing)
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_versions(spark: SparkSession, index: str) -> DataFrame:
    """The index as readers see it: the newest version of every URL over all batches."""
    rows = spark.read.parquet(index)
    return rows.groupBy(F.col("url").alias("_u")).agg(F.max_by(F.struct(*rows.columns), F.struct("batch", "ts")).alias("r")).select("r.*").drop("batch")


class AdaptiveConcurrency:
    """Batch size by measured seconds per document: an EWMA above 1/6 s sheds two, below 1/15 s adds two, within 4 to 30."""

    LOW, HIGH, SLOW, FAST, FILLED = 4, 30, 1 / 6, 1 / 15, 0.8

    def __init__(self, target: int = 10):
        self.target, self.average = target, None

    def observe(self, documents: int, seconds: float) -> int:
        if documents and documents >= self.FILLED * self.target:
            sample = seconds / documents
            self.average = sample if self.average is None else 0.7 * self.average + 0.3 * sample
            change = -2 if self.average >= self.SLOW else 2 if self.average <= self.FAST else 0
            self.target = min(self.HIGH, max(self.LOW, self.target + change))
        return self.target

"""Helpers shared by the operators: shared scratch tables, document order, Arrow batches."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on one machine, as in tests, that setting may be absent; a folder of this process is used then.
    """
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception as error:  # the setting is not there at all
        if "spark.checkpoint.dir" not in str(error):
            raise
        found = None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/searchlake-{os.getpid()}"


class Scratch:
    """Intermediate Parquet tables in the shared folder; :meth:`drop` removes one that is done with.

    A written table cuts the lineage: a lost executor costs the tasks it was running and no more. Results are lazy and
    read these tables, so what is left of them goes when the process ends, or when :meth:`drop` is called. With ``keep`` it
    stays: files that were asked for.
    """

    def __init__(self, spark: SparkSession, keep: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/searchlake-{uuid.uuid4().hex}"
        if not keep:
            atexit.register(self._close)

    def _close(self) -> None:
        try:
            self.drop()
        except Exception as error:  # the JVM may be gone by then; nothing else is to be done
            logging.getLogger(__name__).debug("scratch folder %s is left: %s", self.root, error)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in Arrow batches of at most ``rows`` rows, so memory stays small on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 8 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold a bounded number of text bytes (or one row)."""
    if batch.num_rows <= most_rows and batch.column(batch.schema.get_field_index(text)).nbytes <= most_bytes:
        yield batch
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(sizes[at : at + most_rows])
        take = max(1, int(np.searchsorted(total, most_bytes, side="right")))
        yield batch.slice(at, take)
        at += take


def fold_of(doc_id) -> int:
    """Remainder 0 to 3 of the crc32 of the id as text; 2 is the held-out fold."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def fold_column(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def range_column(bounds: list[int], key: str, step: int = 64):
    """Index of the range that holds a value (0 below the first bound): a coarse search, then one among ``step`` bounds."""
    if not bounds:
        return F.lit(0)
    value = F.col(key)
    if len(bounds) <= step:
        place = F.size(F.filter(F.lit(bounds), lambda b: b <= value))
    else:
        coarse = F.greatest(F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= value)) - 1, F.lit(0)) * step
        place = coarse + F.size(F.filter(F.slice(F.lit(bounds), coarse + 1, F.lit(step)), lambda b: b <= value))
    return F.coalesce(F.greatest(place - 1, F.lit(0)), F.lit(0))


#: Rows of one key are told apart by a hash below this.
TIES = 1 << 20
_NULL = -(1 << 63)


def order_cuts(df: DataFrame, key: str, parts: int) -> dict[int, int]:
    """Ascending key values that cut the rows into about ``parts`` even ranges, each with the number of parts it takes.

    A value that holds the rows of several parts is cut that often. Nulls count as the smallest value.
    """
    filled = df.select(F.coalesce(key, F.lit(_NULL)).alias(key))
    share = [float(i / parts) for i in range(1, parts)] or [0.5]
    row = filled.agg(F.min(key).alias("low"), F.percentile_approx(key, share, max(10_000, 20 * parts)).alias("cuts")).first()
    if row["low"] is None:
        return {}
    return dict(sorted(Counter([int(row["low"]), *(int(x) for x in row["cuts"])]).items()))


def deal_column(cuts: dict[int, int], key: str, tie) -> Column:
    """The part of a row, in the order of (key, tie): of a value with n parts, n - 1 take its rows by ``tie``, one the rows up to the next value."""
    if not cuts:
        return F.lit(0)
    value = F.coalesce(key, F.lit(_NULL))
    first, taken = [], 0
    for copies in cuts.values():
        first.append(taken)
        taken += copies
    place = range_column(list(cuts), key) + 1
    copies = F.element_at(F.lit(list(cuts.values())), place)
    hot = (value == F.element_at(F.lit(list(cuts)), place)) & (copies > 1)
    return F.element_at(F.lit(first), place) + F.when(hot, F.floor(tie * (copies - 1) / TIES)).otherwise(copies - 1)


def prefix_starts(blocks: DataFrame, part: str, block: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """Exclusive running total of ``value`` over (part, block), in three levels.

    No task sees more than the blocks of ``group`` parts, or the totals of all groups.
    """
    from pyspark.sql import Window as W

    keyed = blocks.withColumn("_g", F.floor(F.col(part) / group))
    rows = (W.unboundedPreceding, -1)
    inner = W.partitionBy("_g").orderBy(part, block).rowsBetween(*rows)
    groups = keyed.groupBy("_g").agg(F.sum(value).alias("_t"))
    outer = W.orderBy("_g").rowsBetween(*rows)
    groups = groups.select("_g", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_b"))
    return (
        keyed.withColumn("_w", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(groups, "_g")
        .withColumn(out, (F.col("_w") + F.col("_b")).cast("long"))
        .drop("_g", "_w", "_b")
    )

"""Session helpers: table loading and the settings the queries rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "searchlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows travel to Python in Arrow batches of at most ``rows``: pages and texts are long, and a worker holds what it makes of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the provided tables; columns that are not used later are never read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """Rows of a small table dealt out to all cores: it often lies in one row group, which a single task would read and work on.

    Tables with more than ``part_bytes`` for each core stay as they are read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < part_bytes * cores else df

"""Sources and sinks: queue snapshots, programme and corpus files, index tables and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField(
            "queue",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("url", T.StringType()), T.StructField("priority", T.DoubleType()), T.StructField("source", T.StringType()),
                        T.StructField("content_type", T.StringType()), T.StructField("discovered_at", T.LongType()), T.StructField("attempts", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("seen_urls", T.ArrayType(T.StringType())),
        T.StructField("max_queue_size", T.IntegerType()),
        T.StructField("max_discovered_per_page", T.IntegerType()),
        T.StructField("content_cap", T.IntegerType()),
    ]
)
INDEX = "url string, title string, content string, ts long, authority double, price double, currency string"


def queue_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A crawler snapshot; files of older versions get the defaults of what they lack, the cap is held to 6500."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    return rows.select(
        F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("queue", F.array().cast(SNAPSHOT["queue"].dataType)).alias("queue"),
        F.coalesce("seen_urls", F.array().cast("array<string>")).alias("seen_urls"), F.coalesce("max_queue_size", F.lit(50_000)).alias("max_queue_size"),
        F.coalesce("max_discovered_per_page", F.lit(5)).alias("max_discovered_per_page"), F.least(F.coalesce("content_cap", F.lit(8000)), F.lit(6500)).alias("content_cap"),
    )


def frontier(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.inline("queue"))


def programmes(spark: SparkSession, path: str, field: str = "programs") -> DataFrame:
    """Affiliate programmes from JSON documents, highest priority first; fallbacks that lead nowhere are dropped, the rest of the row stays."""
    from searchlake.functions.url import placeholder_url

    schema = f"{field} array<struct<id:string,kind:string,enabled:boolean,priority:int,network:string,template:string,params:map<string,string>,key_env:string,bid_floor:string,fallback_url:string,host_suffix:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(field))
    real = F.when(F.col("fallback_url").isNotNull() & ~placeholder_url(F.col("fallback_url")), F.col("fallback_url"))
    return rows.withColumn("fallback_url", real).orderBy(F.desc("priority"), "id")


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """A calibration corpus; rows without a prediction keep nulls."""
    schema = "query string, expected string, predicted string, confidence double, correct string, top_score double, result_count int, time_ms double"
    return spark.read.schema(schema).option("header", True).csv(path)


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The index table and what has to be done with it: open, rebuild (only columns too many) or recreate."""
    wanted = {f.name: f.dataType for f in T._parse_datatype_string(INDEX).fields}
    found = spark.read.parquet(path)
    have = {f.name: f.dataType for f in found.schema.fields}
    if have == wanted:
        return found, "open"
    if all(have.get(k) == v for k, v in wanted.items()):
        return found.select(*wanted), "rebuild"
    return spark.createDataFrame([], INDEX), "recreate"


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Rewrites a table in files of about ``file_bytes``; returns how many. Sizes come from the file listing, not from a scan."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    files = max(1, -(-int(size) // file_bytes))
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)
    return files


def table_stats(spark: SparkSession, path: str) -> dict:
    """Rows, files and bytes of a table."""
    rows = spark.read.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = int(folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength())
    return {"documents": rows.count(), "segments": len(rows.inputFiles()), "bytes": size, "megabytes": round(size / (1 << 20), 2)}


def media(hits: DataFrame, vertical: str) -> DataFrame:
    """The columns of images, videos or news."""
    columns = {
        "images": ("title", "url", "image_url", "thumbnail_url", "source", "score"),
        "videos": ("title", "url", "thumbnail", "video_id", "source", "score"),
        "news": ("title", "url", "description", "published_at", "source", "score"),
    }[vertical]
    have = set(hits.columns)
    return hits.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])

"""Rewriting files of drifted schemas: rank the rows, deal them to files, and turn every file into the evolved schema.

Rows are ordered by a custom partitioner over ranges of the crc32 of their id and ``repartitionAndSortWithinPartitions``; counts of
the partitions before give every row its rank. A second partitioner deals by file number with the rank as secondary sort
key, so that each file's rows arrive in order at one task, which streams them to Parquet in bounded row groups. Its
manifest names the row groups; dealt by file number and rank again, they are read one at a time, matched by field id and streamed
into one file of the evolved schema. No row is shuffled for that.

An id with more rows than a partition should hold is cut by a hash of the rows, and rows that are equal in all columns by
their place in the input.

Files are written under a temporary name in a folder beside and moved to their final name, so that repeated attempts of a task change
nothing and none leaves a part of a file in the final folder. Drifted files go when all are rewritten. Driver and executors
open files by the URI of ``spark.checkpoint.dir`` (local, HDFS, S3 or GCS).

Defined results: a null id counts as an empty string for the checksum, comes before ids of the same checksum, and is ``?`` in digests. Rows
that share an id are ordered by a hash of all their columns. An empty table gives no files. Null columns stay null, and only
columns that a file lacks get the defaults. Balances that are not finite are written in digests as ``nan``, ``inf`` or ``-inf``. Columns
beyond those of the schema are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from searchlake.llm.common import partitions, shared_dir

_ID = b"PARQUET:field_id"


def numbered(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    """A nullable schema with field ids from 1."""
    return pa.schema([pa.field(name, kind, metadata={_ID: str(k).encode()}) for k, (name, kind) in enumerate(fields, 1)])


EVOLVED = numbered(
    ("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()),
    ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64()),
)
#: What a column that a file lacks is filled with.
DEFAULTS = {"nation_id": -1, "source": "none"}
SWAPPED, LACKING, NARROWED = ("name", "email"), ("nation_id", "source"), {"balance": pa.float32(), "nation_id": pa.int32()}
FILES, SEED, VERSIONS, DRIFTS = 500, 42, 24, 16
GROUP_ROWS, GROUP_BYTES = 8192, 8 << 20
_BELOW = -(1 << 63) - 1  # sorts before any id


def number_of(field: pa.Field) -> int:
    return int(field.metadata[_ID])


def version_of(file_no: int, seed: int = SEED) -> int:
    found = zlib.crc32(f"{seed}:{file_no}".encode()) % VERSIONS
    return found if found < DRIFTS else 0


def start_schema(version: int) -> pa.Schema:
    """The evolved schema with the drifts of a version; field ids stay with their data."""
    fields = list(EVOLVED)
    if version & 8:
        fields = [f.with_type(NARROWED.get(f.name, f.type)) for f in fields]
    if version & 4:
        fields = [f for f in fields if f.name not in LACKING]
    if version & 2:
        fields = fields[:1] + fields[:0:-1]
    if version & 1:
        other = dict(zip(SWAPPED, reversed(SWAPPED)))
        fields = [f.with_name(other.get(f.name, f.name)) for f in fields]
    return pa.schema(fields)


def evolve(table: pa.Table, schema: pa.Schema = EVOLVED) -> pa.Table:
    """The columns of ``schema``, found by field id whatever their names, order and types; missing ones are filled."""
    at = {number_of(f): i for i, f in enumerate(table.schema)}
    columns = [
        table.column(at[number_of(f)]).cast(f.type) if number_of(f) in at else pa.repeat(pa.scalar(DEFAULTS.get(f.name), f.type), table.num_rows) for f in schema
    ]
    return pa.table(columns, schema=schema)


# files


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, rest = uri.split(":", 1) if "://" in uri else ("", uri)
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def stored(uri: str, attempts: str, schema: pa.Schema, tables: Iterator[pa.Table]) -> list[int]:
    """Streams tables to a file, one row group each, and moves it to its name; returns their numbers of rows."""
    fs, path = opened(uri)
    _, temporary = opened(f"{attempts}/{uuid.uuid4().hex}.parquet")
    rows = []
    with fs.open_output_stream(temporary) as sink, pq.ParquetWriter(sink, schema, compression="zstd") as writer:
        for table in tables:
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            rows.append(table.num_rows)
    try:
        fs.move(temporary, path)
    except OSError:  # some stores refuse to replace what another attempt has moved there, with the same rows
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(temporary)
    return rows


def discard(uri: str) -> None:
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)


# ranks


def keyed(clients: DataFrame) -> DataFrame:
    """crc and tie, then the columns of the schema; the time as microseconds since 1970."""
    if isinstance(clients.schema["updated_at"].dataType, TimestampNTZType):
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', updated_at)")
    else:
        micros = F.unix_micros("updated_at")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    columns = [micros.alias(f.name) if f.name == "updated_at" else F.col(f.name).cast(kinds[f.type]).alias(f.name) for f in EVOLVED]
    rows = clients.select(*columns)
    crc = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")).cast("binary"))
    return rows.select(crc.alias("crc"), F.xxhash64(*EVOLVED.names).alias("tie"), *EVOLVED.names)


def cuts(rows: DataFrame, parts: int) -> list[tuple]:
    """Ascending bounds of (crc, id, tie, place): even ranges of the crc32, and cuts inside every id with more rows than a part should have.

    Fewer than ``parts`` ids can have that many, and as few groups of equal rows, so the bounds stay few at any number of rows.
    """
    found = [((i << 32) // parts,) for i in range(1, parts)]
    share = max(2, rows.count() // parts)
    grouped = rows.groupBy("crc", "client_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    hot = grouped.collect()
    if not hot:
        return found
    for crc, number, n in hot:
        at, copies = (crc, _BELOW if number is None else number), min(parts, -(-n // share))
        found += [(*at, (k << 64) // copies - (1 << 63)) for k in range(copies)]
        found.append((at[0], at[1] + 1))
    named = F.broadcast(rows.sparkSession.createDataFrame([(r["crc"], r["client_id"]) for r in hot], "hot_crc long, hot_id long"))
    theirs = rows.join(named, (F.col("crc") == F.col("hot_crc")) & F.col("client_id").eqNullSafe(F.col("hot_id")), "left_semi")
    for crc, number, tie, n in theirs.groupBy("crc", "client_id", "tie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).collect():
        at, copies = (crc, _BELOW if number is None else number, tie), min(parts, -(-n // share))
        found += [(*at, (k << 32) // copies) for k in range(copies)]
        found.append((*at[:2], tie + 1))
    return sorted(found)


def ranked(clients: DataFrame) -> tuple[RDD, int]:
    """((rank, row) of all rows in order, number of rows); ranks start at 0."""
    rows = keyed(clients)
    bounds = cuts(rows, partitions(clients.sparkSession))

    def key(split: int, part: Iterator) -> Iterator:
        for place, (crc, tie, *row) in enumerate(part):
            scattered = (place * 2654435761 + split * 40503) & 0xFFFFFFFF
            yield (crc, _BELOW if row[0] is None else row[0], tie, scattered), tuple(row)

    ordered = rows.rdd.mapPartitionsWithIndex(key).repartitionAndSortWithinPartitions(len(bounds) + 1, lambda k: bisect_right(bounds, k))
    sizes = ordered.mapPartitionsWithIndex(lambda i, part: [(i, sum(1 for _ in part))]).collect()  # one number a partition
    first, total = {}, 0
    for i, n in sorted(sizes):
        first[i] = total
        total += n
    return ordered.mapPartitionsWithIndex(lambda i, part: ((r, row) for r, (_, row) in enumerate(part, first[i]))), total


# writing and rewriting


def column_tables(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.Table]:
    """Tables of a bounded number of rows and bytes, in a drifted schema."""

    def made() -> pa.Table:
        data = {number_of(f): column for f, column in zip(EVOLVED, zip(*held))}
        arrays = []
        for f in schema:
            kind = EVOLVED.field(number_of(f) - 1).type
            whole = pa.array(data[number_of(f)], pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else pa.array(data[number_of(f)], kind)
            arrays.append(whole.cast(f.type, safe=not pa.types.is_floating(f.type)))
        return pa.table(arrays, schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= GROUP_ROWS or size >= GROUP_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def by_file(rows: RDD, parts: int, files: int) -> RDD:
    """Rows of ((file_no, rank), value): a task has whole files, one after the other, each in the order of its ranks."""
    return rows.repartitionAndSortWithinPartitions(parts, lambda k: k[0] * parts // files)


def write_files(rows: RDD, total: int, folder: str, attempts: str, parts: int, files: int = FILES, seed: int = SEED) -> RDD:
    """(file_no, first rank of a row group, its index, path) of all row groups written."""
    each = 1 + total // files
    count = -(-total // each)
    dealt = by_file(rows.map(lambda r: ((r[0] // each, r[0]), r[1])), min(parts, count), count)

    def run(part: Iterator) -> Iterator:
        for file_no, group in itertools.groupby(part, lambda r: r[0][0]):
            version = version_of(file_no, seed)
            path, schema = f"{folder}/{file_no:05d}-v{version}.parquet", start_schema(version)
            rank = file_no * each
            for k, n in enumerate(stored(path, attempts, schema, column_tables((row for _, row in group), schema))):
                yield file_no, rank, k, path
                rank += n

    return dealt.mapPartitions(run)


def rewrite_files(groups: RDD, folder: str, attempts: str, parts: int, count: int, seed: int = SEED) -> RDD:
    """(file_no, version, start path, path, start columns, rewritten) of all files; row groups are read in the order of their ranks."""
    dealt = by_file(groups.map(lambda g: ((g[0], g[1]), (g[2], g[3]))), min(parts, count), count)

    def run(part: Iterator) -> Iterator:
        for file_no, group in itertools.groupby(part, lambda r: r[0][0]):
            version, mine = version_of(file_no, seed), iter(group)
            first = next(mine)
            start = first[1][1]
            fs, path = opened(start)
            with fs.open_input_file(path) as source:
                found, target = pq.ParquetFile(source), start
                if version:
                    target = f"{folder}/{file_no:05d}-evolved.parquet"
                    stored(target, attempts, EVOLVED, (evolve(found.read_row_group(k)) for _, (k, _) in itertools.chain([first], mine)))
                yield file_no, version, start, target, ",".join(found.schema_arrow.names), bool(version)

    return dealt.mapPartitions(run)


# digests


def whole(values: pa.Array) -> pa.Array:
    """floor(2^20 x) as text, exact at any size."""
    numbers = np.asarray(values.fill_null(0.0).to_numpy(zero_copy_only=False), dtype=np.float64)
    small = np.abs(numbers) < 1 << 42  # false for nan
    text = np.floor(np.where(small, numbers, 0.0) * (1 << 20)).astype(np.int64).astype(str).astype(object)
    for i in np.flatnonzero(~small):
        x = float(numbers[i])
        text[i] = str(math.floor(x) << 20) if math.isfinite(x) else str(x)
    return pc.if_else(values.is_null(), pa.scalar(None, pa.string()), pa.array(text, pa.string()))


def texts(column: pa.Array) -> pa.Array:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    return pc.fill_null(whole(column) if pa.types.is_floating(column.type) else column.cast(pa.string()), "?")


def digest(uri: str) -> tuple[int, int, str, str, str]:
    """n_rows, n_nulls, ids_sha256, rows_sha256, columns of a file, read in bounded batches."""
    rows = nulls = 0
    ids, lines = hashlib.sha256(), hashlib.sha256()
    fs, path = opened(uri)
    with fs.open_input_file(path) as source:
        found = pq.ParquetFile(source)
        for batch in found.iter_batches(GROUP_ROWS):
            if not batch.num_rows:
                continue
            columns = [texts(c) for c in batch.columns]
            for out, sep, values in ((ids, ",", columns[0]), (lines, "\n", pc.binary_join_element_wise(*columns, "|"))):
                out.update(((sep if rows else "") + sep.join(values.to_pylist())).encode())
            rows += batch.num_rows
            nulls += sum(c.null_count for c in batch.columns)
        return rows, nulls, ids.hexdigest(), lines.hexdigest(), ",".join(found.schema_arrow.names)


REPORT = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def rewrite_drifted(clients: DataFrame, files: int = FILES, seed: int = SEED) -> DataFrame:
    """One row for each final file, as read back from it; the files stay in a new folder below ``spark.checkpoint.dir``."""
    spark: SparkSession = clients.sparkSession
    root = f"{shared_dir(spark)}/drifted-{uuid.uuid4().hex}"
    folder, attempts, parts = f"{root}/files", f"{root}/attempts", partitions(spark)
    rows, total = ranked(clients)
    if not total:
        return spark.createDataFrame([], REPORT)
    fs, path = opened(root)
    for made in ("files", "attempts"):
        fs.create_dir(f"{path}/{made}", recursive=True)

    def kept(found: RDD, schema: str, name: str) -> DataFrame:
        spark.createDataFrame(found, schema).write.parquet(f"{root}/{name}")
        return spark.read.schema(schema).parquet(f"{root}/{name}")

    count = -(-total // (1 + total // files))
    groups = kept(write_files(rows, total, folder, attempts, parts, files, seed), "file_no long, first_rank long, row_group long, path string", "row-groups")
    final = kept(rewrite_files(groups.rdd, folder, attempts, parts, count, seed), "file_no long, version long, start string, path string, start_columns string, rewritten boolean", "rewritten")
    final.where("rewritten").select("start").rdd.foreach(lambda r: discard(r["start"]))

    def describe(part: Iterator) -> Iterator:
        for _, r in part:
            n_rows, n_nulls, ids, lines, columns = digest(r["path"])
            yield r["file_no"], r["version"], n_rows, n_nulls, ids, lines, r["start_columns"], columns, r["path"], r["rewritten"]

    dealt = by_file(final.rdd.map(lambda r: ((r["file_no"], 0), r)), min(parts, count), count)
    report = kept(dealt.mapPartitions(describe), REPORT, "report")
    fs.delete_dir(f"{path}/attempts")
    return report

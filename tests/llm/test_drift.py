"""Operator 13 against a plain rewrite of the same rows."""

import datetime
import hashlib
import math
import os
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from searchlake.llm import drift, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "client_id master_id source updated_at name email city nation_id segment balance".split()
KINDS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def micros(t):
    return None if t is None else (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def plain_rewrite(rows, files=500):
    """file_no -> (version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns) for rows of distinct ids."""
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    rows = sorted(rows, key=lambda r: (crc(r[0]), r[0] is not None, r[0] or 0))
    each, out = 1 + len(rows) // files, {}
    for file_no in range(-(-len(rows) // each)):
        version = zlib.crc32(f"42:{file_no}".encode()) % 24
        version = 0 if version > 15 else version
        start = list(NAMES)
        if version & 1:
            start[4], start[5] = "email", "name"
        if version & 2:
            start = start[:1] + start[:0:-1]
        if version & 4:
            start = [c for c in start if c not in ("nation_id", "source")]
        mine = [list(r) for r in rows[file_no * each : (file_no + 1) * each]]
        for r in mine:
            if version & 4:
                r[2], r[7] = "none", -1
            if version & 8 and r[9] is not None:
                r[9] = struct.unpack("f", struct.pack("f", r[9]))[0]
            r[3] = micros(r[3])
        show = lambda r: [*r[:9], None if r[9] is None else math.floor(1048576 * r[9])]
        text = lambda x: "?" if x is None else str(x)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[file_no] = (
            version, len(mine), sum(x is None for r in mine for x in r), sha(",".join(text(r[0]) for r in mine)),
            sha("\n".join("|".join(map(text, show(r))) for r in mine)), ",".join(start),
        )
    return out


def got(report):
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns) for r in report}


def test_query_equals_a_plain_rewrite(spark):
    report = queries.op13_drift_rewrite(spark, SF).collect()
    assert got(report) == plain_rewrite([tuple(r) for r in spark.read.parquet(f"{SF}/clients.parquet").select(*NAMES).collect()])
    folder = {os.path.dirname(r.path) for r in report}
    assert len(folder) == 1 and sorted(os.listdir(folder.pop())) == sorted(os.path.basename(r.path) for r in report)
    for r in report:
        assert r.columns == ",".join(NAMES) and r.rewritten == (r.version != 0)
        schema = pq.read_schema(r.path)
        assert [(f.name, drift.number_of(f)) for f in schema] == [(c, k) for k, c in enumerate(NAMES, 1)]
        assert schema.field("nation_id").type == pa.int64() and schema.field("balance").type == pa.float64() and all(f.nullable for f in schema)


def test_every_version_keeps_rows_and_ids():
    rows = [(i, None if i % 3 else i, "web", 1_700_000_000_000_000 + i, f"n{i}", None, "Ärla", i % 5, "x", i / 7) for i in range(50)]
    for version in range(16):
        schema = drift.start_schema(version)
        table = pa.concat_tables(drift.column_tables(iter(rows), schema))
        back = drift.evolve(table).to_pydict()
        assert list(back) == NAMES and back["name"] == [r[4] for r in rows] and back["email"] == [None] * 50
        assert back["nation_id"] == [-1 if version & 4 else r[7] for r in rows] and back["source"] == ["none" if version & 4 else "web"] * 50
        single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
        assert back["balance"] == [single(r[9]) if version & 8 else r[9] for r in rows]
        assert schema.names == drift.start_schema(version).names and drift.number_of(schema.field(0)) == 1


@pytest.fixture(scope="module")
def odd_clients(spark):
    """A hot id, equal rows, null ids, nulls in every column, numbers without an end, an extra column."""
    day = datetime.datetime(2024, 2, 29, 23, 59, 59, 999999)
    rows = [(i, i, "web", day, f"n{i}", None, "a|b", i % 25, "s", float(i)) for i in range(300)]
    rows += [(7, k, "crm", day, "same id", "e", None, 1, None, 0.5) for k in range(150)]
    rows += [(7, 7, "crm", day, "equal", "e", None, 1, None, 0.5)] * 150
    rows += [(None, k, None, None, None, None, None, None, None, None) for k in range(40)]
    rows += [(9_000 + k, None, "", datetime.datetime(1969, 1, 1), "\n", "", "é", None, "", x) for k, x in enumerate((float("nan"), float("inf"), -1e300, -0.1, None))]
    return spark.createDataFrame([(*r, "extra") for r in rows], KINDS + ", crc string").repartition(3)


def test_odd_rows(spark, odd_clients):
    report = sorted(drift.rewrite_drifted(odd_clients).collect(), key=lambda r: r.file_no)
    assert sum(r.n_rows for r in report) == 645 and [r.n_rows for r in report[:-1]] == [2] * 322
    back = [i for r in report for i in pq.read_table(r.path.removeprefix("file://")).column("client_id").to_pylist()]
    want = sorted((r[0] for r in odd_clients.select("client_id").collect()), key=lambda i: (zlib.crc32(b"" if i is None else str(i).encode()), i is not None, i or 0))
    assert back == want
    assert got(report) == got(drift.rewrite_drifted(odd_clients.repartition(7)).collect())  # ties don't depend on the partitions
    assert drift.rewrite_drifted(odd_clients.where("false")).collect() == []


def test_hot_ids_are_cut(odd_clients):
    rows, total = drift.ranked(odd_clients)
    ranks = rows.map(lambda r: r[0]).glom().map(len).collect()
    assert total == sum(ranks) == 645 and max(ranks) <= 2 * 645 // 4
    assert rows.map(lambda r: r[0]).collect() == list(range(645))


def test_whole_numbers_of_digests():
    assert drift.whole(pa.array([1.5, -0.1, None, float("nan"), float("inf"), 1e300])).to_pylist() == ["1572864", "-104858", None, "nan", "inf", str(int(1e300) << 20)]


def test_repeated_attempts_change_nothing(tmp_path):
    rows = [(i, i, "web", 0, "n", "e", "c", 1, "s", 1.0) for i in range(20_000)]
    schema = drift.start_schema(3)
    os.makedirs(tmp_path / "files"), os.makedirs(tmp_path / "attempts")
    for _ in range(2):
        assert sum(drift.stored(f"{tmp_path}/files/a.parquet", f"{tmp_path}/attempts", schema, drift.column_tables(iter(rows), schema))) == 20_000
    assert os.listdir(tmp_path / "files") == ["a.parquet"] and not os.listdir(tmp_path / "attempts")
    assert pq.ParquetFile(tmp_path / "files/a.parquet").num_row_groups == 3
    drift.discard(f"{tmp_path}/files/a.parquet")
    drift.discard(f"file://{tmp_path}/files/a.parquet")
    assert os.listdir(tmp_path / "files") == []

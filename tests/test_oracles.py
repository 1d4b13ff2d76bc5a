import os

import pytest

from searchlake.catalog import all_oracles, all_queries
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries that have nothing to report on the smallest tables.
MAY_BE_EMPTY = {"recall_gap", "semantic_gate", "linear_candidates"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows_as_duckdb(spark, con, name):
    rows = compare(spark, con, all_queries()[name], all_oracles()[name], SF)
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_rows_without_oracle(spark, name):
    df = all_queries()[name](spark, SF)
    assert df.limit(1).count() == 1 and len(set(df.columns)) == len(df.columns)

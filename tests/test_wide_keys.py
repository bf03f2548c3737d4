"""Queries against their SQL on tables whose keys are larger or odder than those of the small test tables."""

import os

import duckdb
import pytest

from marginalia.plans.catalog import CATALOG
from tests.compare import difference
from tests.conftest import DATA


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """Orders of the test tables with customer numbers that look like years, or have six digits and more."""
    folder = tmp_path_factory.mktemp("run-wide")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CAST(CASE o_orderkey % 4 WHEN 0 THEN 1500 + o_orderkey % 600 WHEN 1 THEN 100000 + o_orderkey
        WHEN 2 THEN 12345678 + o_orderkey ELSE o_custkey END AS BIGINT) AS o_custkey) FROM '{DATA}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    return os.fspath(folder), con


@pytest.mark.parametrize("name", ["number_extract", "search_gate"])
def test_customer_numbers_of_any_size(spark, shifted, name):
    folder, con = shifted
    query, sql = CATALOG[name]
    assert difference(spark, con, folder, query, sql) is None

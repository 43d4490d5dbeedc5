"""Queries whose text holds a key, on keys of more than 16 bits, against DuckDB."""

import os

import duckdb
import pytest

from pathloom.plans.registered import ORACLES, QUERIES

from .test_queries import DATA, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The customers' keys around 65536."""
    at, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    for t, key in {"orders": "o_custkey + 65472 as o_custkey", "customer": "c_custkey + 65472 as c_custkey", "lineitem": "l_orderkey as l_orderkey"}.items():
        con.execute(f"copy (select * replace ({key}) from '{DATA}/{t}.parquet') to '{at}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["cidr_canonical_v6", "lpm_profile_v6", "route_cache_file"])
def test_equals_sql(spark, shifted, name):
    at, con = shifted
    assert rows(QUERIES[name](spark, at).toPandas()) == rows(con.execute(ORACLES[name]).df())

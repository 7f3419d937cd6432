"""Every registered query with an oracle equals its DuckDB SQL on the same tables."""

import os

import pytest

from tests.oracle import compare, duck

from __spark_entry__ import oracle_sql, queries

SF = os.environ.get("CLADEML_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, queries()[name], oracle_sql()[name], SF, con)
    assert r["cols"], (r["s_cols"], r["d_cols"])
    assert r["rows"] == r["oracle_rows"]
    assert r["values"], r["diff"]


def test_every_query_callable_registered():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100

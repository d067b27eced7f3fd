"""Every report against its DuckDB statement, as the driver checks it."""

from __future__ import annotations

import os

import pytest
from conftest import SF001, SF01
from oracle_harness import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from mercato.plans import REPORTS

NAMES = sorted(REPORTS)


def test_every_report_is_registered_and_has_a_statement():
    assert set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())
    assert len(NAMES) == 36


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["customer_state", "total_orders", "total_revenue"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck001():
    return duck(SF001)


@pytest.fixture(scope="module")
def duck01():
    return duck(SF01)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_sf0001(spark, duck001, name):
    r = compare(spark, SF001, name, queries(), oracle_sql(), duck001)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


@pytest.mark.skipif(not os.path.isdir(SF01), reason="sf0.01 data not present")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_sf001(spark, duck01, name):
    r = compare(spark, SF01, name, queries(), oracle_sql(), duck01)
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


SF1 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck1():
    return duck(SF1)


@pytest.mark.skipif(
    os.environ.get("MERCATO_SF01") != "1", reason="set MERCATO_SF01=1 to check sf0.1 as well"
)
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_sf01(spark, duck1, name):
    r = compare(spark, SF1, name, queries(), oracle_sql(), duck1)
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r

"""Every registered query against its DuckDB oracle (the driver's correctness gate, locally)."""

import os

import pytest

import __spark_entry__ as E
from chainlens.plans.catalog import QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.oracle_check import compare, duck

NAMES = sorted(QUERIES)
FULL = os.environ.get("CHAINLENS_ORACLE_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(FULL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), FULL)
    assert r["ok"] is True, r


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["customer", "total_orders", "total_revenue", "avg_order_value", "revenue_share_pct",
                          "running_total"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["revenue_by_customer", "plant_efficiency", "revenue_summary", "kpi_table"])
def test_headline_queries_at_sf001(spark, name):
    c = duck(SF_ORACLE)
    r = compare(spark, c, name, E.queries()[name], E.oracle_sql()[name], SF_ORACLE)
    assert r["ok"], r

"""The one-pass dashboard bundle equals the stand-alone panel queries."""

import pytest

import __spark_entry__ as E
from chainlens.operators import dashboard, events
from chainlens.sources import testdata as td

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bundle(spark):
    t = td.Tables(spark, SF)
    return dashboard.dashboard_bundle(td.order_totals(t, "Delivered", dims=("customer",)),
                                      td.inspections(t, dims=("product",)),
                                      events.flatten_events(td.machine_events(t, "cycle_complete")))


@pytest.mark.parametrize("name", ["panel_monthly", "panel_oee", "panel_defects", "panel_rolling",
                                  "panel_customers", "kpi_table"])
def test_bundle_equals_panel_query(spark, bundle, name):
    got = {tuple(r) for r in bundle[name].collect()}
    want = {tuple(r) for r in E.queries()[name](spark, SF).collect()}
    assert got == want and len(got) > 0
    assert bundle[name].columns == E.queries()[name](spark, SF).columns

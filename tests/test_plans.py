"""Physical-plan properties the design relies on."""

import re

import pytest

import __spark_entry__ as E
from chainlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_reaches_parquet_scan(spark):
    assert "EqualTo(o_orderstatus,F)" in plan_of(spark, "monthly_revenue_mom")


def test_event_type_filter_reaches_parquet_scan(spark):
    assert "EqualTo(event_type,click)" in plan_of(spark, "oee_by_machine")


@pytest.mark.parametrize("name", ["top_customers", "top_alerts", "supplier_scorecard_top10", "oee_bottom5"])
def test_topk_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan_of(spark, name)


def test_sample_is_take_ordered_over_lines_alone(spark):
    """The seeded sample is a TakeOrderedAndProject over the line items, with no join."""
    from pyspark.sql import functions as F

    from chainlens.operators import suppliers
    from chainlens.sources import testdata as td

    li = td.Tables(spark, SF)["lineitem"].select(F.col("l_orderkey").alias("order_id"),
                                                 F.col("l_linenumber").alias("line_number"),
                                                 F.col("l_suppkey").alias("supplier_id"))
    p = suppliers.sample_supplier_ids(li)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p and "Join" not in p and "Exchange" not in p


def test_rank_filter_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in plan_of(spark, "top_products_per_customer")


def test_no_python_udfs_anywhere(spark):
    for name in QUERIES:
        p = plan_of(spark, name)
        assert not any(x in p for x in ("Python", "Pandas", "Arrow")), name


def test_building_a_query_runs_no_job(spark, monkeypatch):
    """No checkpoint and no action while a query is built (Parquet footers are read for the schema)."""
    from pyspark.sql.classic.dataframe import DataFrame

    def ran(*a, **k):
        raise AssertionError("a job while building")

    for name in ("checkpoint", "localCheckpoint", "collect", "count", "first", "head", "take", "toPandas", "toArrow",
                 "isEmpty", "cache", "persist"):
        monkeypatch.setattr(DataFrame, name, ran)
    for name, q in QUERIES.items():
        q(spark, SF)


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _exchanges(plan):
    """(key text, what stands below up to the next exchange) of every hash exchange."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(" in line:
            below = []
            for x in lines[i + 1:]:
                if "Exchange" in x:
                    break
                below.append(x)
            yield line.split("hashpartitioning(")[1], "\n".join(below)


@pytest.mark.parametrize("name", ["defects_by_product_plant", "defects_by_product_plant_rounded",
                                  "defect_stats_by_product", "panel_defects"])
def test_inspections_are_combined_before_they_are_shuffled(spark, no_broadcast, name):
    met = [below for key, below in _exchanges(plan_of(spark, name)) if "l_returnflag" in below or "l_tax" in below]
    assert met and all("functions=[partial_" in below for below in met)


@pytest.mark.parametrize("name", ["network_stats", "supplier_edges", "top_products_per_customer", "orders_enriched"])
def test_customer_is_joined_at_order_grain(spark, no_broadcast, name):
    for key, below in _exchanges(plan_of(spark, name)):
        if "custkey" in key.split(",")[0]:
            assert "l_orderkey" not in below and "l_suppkey" not in below, (name, key)


def test_network_stats_expands_nothing(spark):
    assert "Expand" not in plan_of(spark, "network_stats")


@pytest.mark.parametrize("name", ["customer_cohort", "customer_cohort_segment", "customer_months"])
def test_cohort_is_hash_aggregated(spark, name):
    assert "SortAggregate" not in plan_of(spark, name) and "ObjectHashAggregate" not in plan_of(spark, name)


def test_scan_is_pruned(spark):
    p = plan_of(spark, "sla_breach")
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in p


def test_order_totals_reuse_partitioning_for_the_join(spark):
    """Lines are combined per order before the orders join, and that aggregate's
    order-key partitioning feeds the join directly (no second exchange)."""
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    try:
        p = plan_of(spark, "monthly_revenue_mom")
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, prev)
    lines = p.splitlines()
    smj = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    agg = next(i for i in range(smj, len(lines)) if "HashAggregate(keys=[order_id" in lines[i])
    # only a local Sort may sit between the join and the per-order aggregate
    assert all("Exchange" not in line for line in lines[smj:agg]), p


@pytest.mark.parametrize("name", ["network_stats", "network_stats_by_key", "revenue_summary", "lead_time_summary",
                                  "lead_time_stats", "defect_stats_by_product", "revenue_by_customer",
                                  "revenue_by_customer_key", "revenue_by_customer_share"])
def test_facts_are_scanned_once(spark, no_broadcast, name):
    """In the final adaptive plan, where reused exchanges stand without what is below them."""
    df = QUERIES[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    for table in ("lineitem", "orders", "part", "customer"):
        assert len(re.findall(rf"FileScan parquet.*/{table}\.parquet", final)) <= 1, table


def test_prefix_sum_joins_on_the_window_partitioning(spark, no_broadcast):
    """The rows are shuffled once to their buckets: the join with the offsets adds no exchange to them."""
    df = QUERIES["revenue_summary"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # to the buckets: the rows, their sums, and the offsets
    assert "isnull(_cl_bucket" not in final and len(re.findall(r"hashpartitioning\(_cl_(?:o__cl_)?bucket", final)) == 3

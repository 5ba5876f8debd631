"""The domain-file entry point: export the test tables in the domain formats
(CSV tables, JSON-Lines documents), run every domain analysis on them, and
check it agrees with the registered test-table queries on the same rows."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from chainlens import cli
from chainlens.plans import domain
from chainlens.sources import testdata as td

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def domain_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("domain"))
    t = td.Tables(spark, SF)
    key = F.concat_ws("-", F.col("order_id").cast("string"), F.col("line_number").cast("string"))
    lines = td.orders_lines(t, status=None)
    (lines.select(key.alias("order_id"), "order_date", "delivery_date", "customer", "product", "plant",
                  F.concat(F.lit("SUP_"), F.col("supplier_id").cast("string")).alias("supplier_id"),
                  F.col("quantity").cast("int").alias("quantity"),
                  F.round(F.col("revenue") / F.col("quantity"), 2).cast("decimal(10,2)").alias("unit_price"),
                  F.lit(0).cast("decimal(5,3)").alias("discount_pct"), "revenue", "status")
     .write.option("header", True).csv(f"{out}/orders.csv"))
    (td.suppliers(t).select(F.concat(F.lit("SUP_"), F.col("supplier_id").cast("string")).alias("supplier_id"),
                            "supplier_name", "country", "tier", "on_time_rate", "quality_score", "avg_lead_days",
                            F.lit(1000).cast("decimal(12,2)").alias("contract_value"), "active")
     .write.option("header", True).csv(f"{out}/suppliers.csv"))
    ins = td.inspections(t)
    (ins.select("inspection_id", F.col("inspection_id").alias("order_id"), "product", "plant", "inspection_date",
                "batch_size", F.col("defects_found").cast("int").alias("defects_found"),
                F.when(F.col("defects_found") > 0, "Dimensional").otherwise("None").alias("defect_type"),
                F.lit("INS_EMP_01").alias("inspector_id"), "passed", "defect_rate")
     .write.option("header", True).csv(f"{out}/quality_inspections.csv"))
    ev = td.machine_events(t)
    (ev.select(F.col("event_id").cast("string").alias("event_id"), F.col("timestamp").cast("string").alias("timestamp"),
               F.col("machine_id").cast("string").alias("machine_id"), "plant", "event_type", "operator_id", "metadata")
     .write.json(f"{out}/machine_events.json"))
    fb = td.customer_feedback(t)
    (fb.select(F.col("feedback_id").cast("string").alias("feedback_id"), "customer", "product",
               "date", *[c for c in fb.columns
                                                              if c not in ("feedback_id", "customer", "product", "date")])
     .write.json(f"{out}/customer_feedback.json"))
    return out


def test_every_domain_analysis_runs(spark, domain_dir):
    d = domain.load(spark, domain_dir, json_lines=True)
    assert set(domain.DOMAIN_QUERIES) <= set(E.queries())
    for name, fn in domain.DOMAIN_QUERIES.items():
        n = fn(d).count()
        # the violation reports may find nothing; every other analysis has rows
        assert n > 0 or name in ("check_pk", "check_fk", "check_enum"), name


@pytest.mark.parametrize("name", ["revenue_by_customer", "monthly_revenue_mom", "sla_breach", "oee_by_machine",
                                  "sentiment_by_customer", "rolling_summary", "revenue_summary", "kpi_table"])
def test_domain_equals_test_table_query(spark, domain_dir, name):
    d = domain.load(spark, domain_dir, json_lines=True)
    a = {tuple(str(v) for v in r) for r in domain.DOMAIN_QUERIES[name](d).collect()}
    b = {tuple(str(v) for v in r) for r in E.queries()[name](spark, SF).collect()}
    assert a == b


def test_decimal_conformity_on_raw_text(spark, domain_dir):
    d = domain.load(spark, domain_dir, json_lines=True)
    rows = domain.DOMAIN_QUERIES["decimal_conformity"](d).collect()
    assert {r.column_name for r in rows} >= {"revenue", "on_time_rate", "defect_rate"}
    assert all(r.non_conforming == 0 for r in rows)


def test_cli_exports(spark, domain_dir, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["--data-dir", domain_dir, "--json-lines", "--out", out, "revenue_by_customer", "events_flat"]) == 0
    assert spark.read.option("header", True).csv(f"{out}/revenue_by_customer").count() == 5
    assert os.path.isdir(f"{out}/events_flat")


def test_cli_shows_heads_and_whole_results(spark, domain_dir, capsys):
    assert cli.main(["--data-dir", domain_dir, "--show", "2", "revenue_by_customer"]) == 0
    head = capsys.readouterr().out.splitlines()
    assert head[0] == "== revenue_by_customer" and head[1].startswith("customer\t") and len(head) == 4
    assert cli.main(["--data-dir", domain_dir, "--show", "all", "revenue_by_customer"]) == 0
    whole = capsys.readouterr().out.splitlines()
    assert whole[:4] == head and len(whole) == 7


def test_cli_publishes(spark, domain_dir, tmp_path):
    from chainlens.sources.published import read_published

    out = str(tmp_path / "pub")
    for _ in range(2):
        assert cli.main(["--data-dir", domain_dir, "--out", out, "--format", "parquet", "--publish", "run-1", "kpi_table"]) == 0
    assert read_published(spark, f"{out}/kpi_table").count() == 6


def test_domain_dashboard_bundle(spark, domain_dir, tmp_path):
    from chainlens.operators import dashboard

    d = domain.load(spark, domain_dir, json_lines=True)
    built = dashboard.dashboard_bundle(d.orders, d.inspections, d.events)
    for name, df in built.items():
        want = {tuple(str(v) for v in r) for r in domain.DOMAIN_QUERIES[name](d).collect()}
        assert {tuple(str(v) for v in r) for r in df.collect()} == want, name
    out = str(tmp_path / "dash")
    assert cli.main(["--data-dir", domain_dir, "--json-lines", "--dashboard", "--out", out]) == 0
    assert spark.read.option("header", True).csv(f"{out}/kpi_table").count() == 6

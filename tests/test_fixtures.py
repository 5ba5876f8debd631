"""Hand-computed micro fixtures for the semantic traps (FIXTURES.md §3) and invariants."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chainlens.functions.numeric import round_half_up
from chainlens.functions.windows import exact_quantiles, running_sum
from chainlens.operators import (checks, events, feedback, network, plant, quality, revenue, rolling, sla, stats,
                                 suppliers)

ORDERS = ("order_id long, line_number int, order_date date, delivery_date date, customer string, product string, "
          "plant string, supplier_id long, revenue decimal(14,2), status string, c_custkey long")
INSP = ("inspection_id string, order_id long, product string, plant string, batch_size int, "
        "defects_found decimal(10,4), defect_rate decimal(6,4), passed int")
SUPP = ("supplier_id long, supplier_name string, tier string, country string, on_time_rate decimal(5,3), "
        "quality_score decimal(3,2), avg_lead_days int, active int")
D = dt.date


def orders(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(order_id=i + 1, line_number=1, order_date=D(2023, 1, 1), delivery_date=D(2023, 1, 5),
                    customer="A", product="P", plant="X", supplier_id=1, revenue=Decimal("1.00"),
                    status="Delivered", c_custkey=1)
        base.update(r)
        base["revenue"] = Decimal(str(base["revenue"])) if base["revenue"] is not None else None
        full.append(base)
    return spark.createDataFrame(full, ORDERS)


def test_rounding_half_up(spark):
    df = spark.createDataFrame([(0.285,), (1.005,), (0.125,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 2)).collect()]
    assert got == [0.29, 1.01, 0.13]


def test_rolling_window_is_31_calendar_days(spark):
    daily = spark.createDataFrame([(D(2023, 1, 1), Decimal(1)), (D(2023, 1, 31), Decimal(2)), (D(2023, 2, 1), Decimal(4))],
                                  "date date, revenue decimal(14,2)")
    got = [r.rolling_30d_revenue for r in rolling.rolling_revenue(daily).collect()]
    assert got == [1.0, 3.0, 6.0]


def test_lag_skips_missing_month(spark):
    o = orders(spark, [dict(order_date=D(2023, 1, 15), revenue=10), dict(order_date=D(2023, 3, 10), revenue=15)])
    rows = {r.month: r for r in revenue.monthly_revenue_mom(o).collect()}
    assert rows["2023-03"].prev_month_revenue == 10.0 and rows["2023-03"].mom_growth_pct == 50.0


def test_zero_base_growth_is_null(spark):
    o = orders(spark, [dict(order_date=D(2023, 1, 15), revenue=0), dict(order_date=D(2023, 2, 10), revenue=5)])
    rows = {r.month: r for r in revenue.monthly_revenue_orders(o).collect()}
    assert rows["2023-02"].mom_growth_pct is None


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "x int")
    assert exact_quantiles(df, "x", [0.95], ["p"]).first().p == pytest.approx(8.8)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.randint(0, 50)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs, [f"q{i}" for i in range(len(probs))], by=["g"],
                          mean_name="m").collect()
    for r in got:
        xs = np.array([x for g, x in rows if g == r.g])
        for i, p in enumerate(probs):
            assert r[f"q{i}"] == pytest.approx(np.percentile(xs, p * 100))
        assert r.m == pytest.approx(xs.mean())


def test_running_sum_matches_single_partition_window(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", rng.randint(0, 30)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    order = [F.col("v").desc(), F.col("k").asc()]
    got = {r.k: r.run for r in running_sum(df, "v", "v", "run", descending=True, ties=["k"]).collect()}
    want = {r.k: r.run for r in df.withColumn(
        "run", F.sum("v").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).collect()}
    assert got == want


def test_ols_coefficients_and_pvalue(spark):
    o = orders(spark, [dict(order_date=D(2023, m, 1), revenue=v) for m, v in zip(range(1, 5), (1.0, 2.5, 2.9, 4.4))])
    coef = {r.term: r for r in stats.revenue_trend_ols(o, digits=6).collect()}
    assert coef["t"].estimate == pytest.approx(1.06) and coef["(Intercept)"].estimate == pytest.approx(0.05)
    assert coef["t"].std_error == pytest.approx(0.155563, abs=1e-6)
    assert coef["t"].t_value == pytest.approx(6.813938, abs=1e-6)
    assert stats.revenue_trend_fit(o).first().r_squared == pytest.approx(0.958703, abs=1e-6)
    pv = {r.term: r for r in stats.revenue_trend_pvalues(o).collect()}
    assert pv["t"].p_value == pytest.approx(0.020866, abs=1e-6)
    assert pv["t"].estimate == pytest.approx(1.06)


def _insp(spark, rows):
    return spark.createDataFrame([dict(inspection_id=f"i{i}", order_id=i, product="P", plant="X", passed=1,
                                       defect_rate=Decimal("0.0100"), **r) for i, r in enumerate(rows)], INSP)


def test_quality_rag_raw_vs_rounded_and_null(spark):
    ins = _insp(spark, [dict(batch_size=1000, defects_found=Decimal("9.996"))])
    assert quality.defects_by_product_plant(ins).first().quality_rag == "GREEN"
    assert quality.defects_by_product_plant_rounded(ins).first().quality_rag == "AMBER"
    zero = _insp(spark, [dict(batch_size=0, defects_found=Decimal("0"))])
    r = quality.defects_by_product_plant(zero).first()
    assert r.defect_rate_pct is None and r.quality_rag == "RED"


def test_fanout_and_dedupe(spark):
    heads = spark.createDataFrame([(1, "A", "X", Decimal("100.00"), "Delivered")],
                                  "order_id long, customer string, plant string, revenue decimal(14,2), status string")
    ins = _insp(spark, [dict(batch_size=10, defects_found=Decimal(0)), dict(batch_size=10, defects_found=Decimal(0))])
    ins = ins.withColumn("order_id", F.lit(1).cast("long"))
    r = plant.plant_efficiency(heads, ins).first()
    assert (r.total_revenue, r.total_orders, r.avg_order_value) == (200.0, 1, 100.0)
    assert plant.plant_efficiency(heads, ins, dedupe_orders=True).first().total_revenue == 100.0


def test_lookup_unknown_only_for_missing_key(spark):
    o = orders(spark, [dict(supplier_id=1), dict(supplier_id=2)])
    s = spark.createDataFrame([(1, "S1", None, "IN", Decimal("0.9"), Decimal("4.0"), 5, 1)], SUPP)
    got = {r.supplier_id: r.supplier_tier for r in suppliers.enrich_orders(o, s).collect()}
    assert got == {1: None, 2: "Unknown"}


def test_rank_keeps_ties(spark):
    o = orders(spark, [dict(product=p, revenue=v) for p, v in zip("abcd", (9, 9, 8, 7))])
    got = sorted((r.product, r.product_rank_within_customer) for r in revenue.top_products_per_customer(o).collect())
    assert got == [("a", 1), ("b", 1), ("c", 3)]


def test_tags_empty_list(spark):
    docs = spark.createDataFrame([([],), (["x", "y"],)], "tags array<string>")
    assert {r.tag for r in feedback.tag_frequency(docs, keep_empty=False).collect()} == {"x", "y"}
    assert {r.tag for r in feedback.tag_frequency(docs, keep_empty=True).collect()} == {"x", "y", ""}


def test_alerts_drop_null_code(spark):
    ev = spark.createDataFrame([("alert", 1, None), ("alert", 1, "ALT_1"), ("alert", 2, "ALT_1")],
                               "event_type string, machine_id long, alert_code string")
    got = {(r.machine_id, r.alert_code) for r in events.top_alerts(ev).collect()}
    assert got == {(1, "ALT_1"), (2, "ALT_1")}


def test_sla_threshold(spark):
    o = orders(spark, [dict(delivery_date=D(2023, 1, 1) + dt.timedelta(days=d)) for d in (20, 21, 22)])
    r = sla.sla_breach(o).first()
    assert (r.total, r.within_sla, r.breaches, r.breach_pct) == (3, 2, 1, 33.3333)
    assert r.within_sla + r.breaches == r.total


def test_scorecard_supplier_without_orders(spark):
    s = spark.createDataFrame([(1, "S1", "Tier 1", "IN", Decimal("0.96"), Decimal("4.6"), 5, 1),
                               (2, "S2", "Tier 2", "IN", Decimal("0.90"), Decimal("4.0"), 5, 1)], SUPP)
    o = orders(spark, [dict(supplier_id=1, revenue=10)])
    rows = suppliers.supplier_scorecard(s, o).collect()
    assert [r.supplier_id for r in rows] == [1, 2]
    assert (rows[1].total_orders, rows[1].total_revenue) == (0, None)
    assert [r.supplier_rag for r in rows] == ["GREEN", "AMBER"]


def test_graph_stats(spark):
    o = orders(spark, [dict(supplier_id=1, customer=c) for c in "abc"] + [dict(supplier_id=2, customer="a")])
    e = network.supplier_edges(o)
    st = network.network_stats(o).first()
    assert (st.num_nodes, st.num_edges, st.avg_degree) == (5, 4, 2.0)
    assert [tuple(r) for r in network.critical_suppliers(e).collect()] == [(1, 3, c) for c in "abc"]
    assert [tuple(r) for r in network.critical_suppliers(e, with_customers=False).collect()] == [(1, 3)]
    adj = [tuple(r) for r in network.supplier_adjacency(e).collect()]
    assert adj == [(1, 3, "a"), (1, 3, "b"), (1, 3, "c"), (2, 1, "a")]


def test_sensor_outlier_flagged(spark):
    rows = [(i, 1, 20.0 + (i % 3) * 0.1, 1.0, 2.0) for i in range(30)] + [(99, 1, 95.0, 1.0, 2.0)]
    ev = spark.createDataFrame(rows, "event_id long, machine_id long, temperature_c double, vibration_hz double, "
                                     "pressure_bar double")
    flags = events.sensor_anomaly_flags(ev)
    assert [r.event_id for r in flags.where("temperature_c_anomaly = 1").collect()] == [99]
    tot = {r.sensor: r.anomalies for r in events.sensor_anomaly_totals(flags).collect()}
    assert tot == {"temperature_c_anomaly": 1, "vibration_hz_anomaly": 0, "pressure_bar_anomaly": 0}


def test_sentiment_missing_class_counts_zero(spark):
    fb = spark.createDataFrame([("A", "positive"), ("A", "neutral"), ("B", "negative")],
                               "customer string, sentiment string")
    got = {r.customer: (r.negative, r.total, r.neg_rate) for r in feedback.sentiment_by_customer(fb).collect()}
    assert got == {"A": (0, 2, 0.0), "B": (1, 1, 100.0)}


def test_constraint_checks(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "fk long")
    fk = {(r.key, r.n) for r in checks.check_fk(child, "fk", parent, "id", "c->p").collect()}
    assert fk == {("3", 2)}
    pk = {(r.key, r.n) for r in checks.check_pk(child.withColumnRenamed("fk", "k"), "k", "t").collect()}
    assert pk == {("3", 2), (None, 1)}
    df = spark.createDataFrame([("x", None)], "supplier_id string, tier string")
    filled = checks.apply_defaults(df, "suppliers").first()
    assert filled.tier is None and filled.active == 1
    assert "created_at" in checks.with_load_timestamp(df).columns
    bad = spark.createDataFrame([(123.456,), (1.5,)], "v double")
    conf = checks.decimal_conformity(bad, {"v": (3, 2)}, "t").first()
    assert conf.non_conforming == 1
    enum = checks.check_enum(spark.createDataFrame([("Tier 9",), ("Tier 1",)], "tier string"), "tier",
                             ("Tier 1", "Tier 2", "Tier 3"), "s").collect()
    assert [(r.value, r.n) for r in enum] == [("Tier 9", 1)]


def test_invariants_on_testdata(spark):
    import __spark_entry__ as E

    d = "/root/testdata/sf0.001"
    q = E.queries()
    rc = q["revenue_by_customer"](spark, d).collect()
    assert sum(r.revenue_share_pct for r in rc) == pytest.approx(100.0, abs=0.05)
    assert max(r.running_total for r in rc) == pytest.approx(sum(r.total_revenue for r in rc), abs=0.01)
    s = q["sentiment_by_customer"](spark, d).collect()
    assert all(r.negative + r.neutral + r.positive == r.total for r in s)
    edges = q["supplier_edges"](spark, d).agg(F.sum("total_revenue")).first()[0]
    daily = q["daily_revenue"](spark, d).agg(F.sum("revenue")).first()[0]
    assert edges == pytest.approx(daily, rel=1e-9)
    sb = q["sla_breach"](spark, d).first()
    assert sb.within_sla + sb.breaches == sb.total


def test_round_every_numeric_column(spark):
    from chainlens.functions.numeric import round_numeric_columns

    df = spark.createDataFrame([("p", 0.123456, Decimal("1.23455"), 7)], "product string, a double, b decimal(10,5), n int")
    r = round_numeric_columns(df, 4).first()
    assert (r.product, r.a, r.b, r.n) == ("p", 0.1235, 1.2346, 7)


def test_sized_conf():
    from chainlens.session import sized_conf

    c = sized_conf(100 * 2**40, 4000)
    assert c["spark.sql.shuffle.partitions"] == str(100 * 2**40 // (256 * 2**20))
    assert sized_conf(10 * 2**20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_defect_stats_null_product_is_a_group(spark):
    ins = spark.createDataFrame([(None, 10, Decimal("1"), Decimal("0.0100")), (None, 10, Decimal("3"), Decimal("0.0300")),
                                 ("P", 10, Decimal("2"), Decimal("0.0200"))],
                                "product string, batch_size int, defects_found decimal(10,4), defect_rate decimal(6,4)")
    got = {r.product: (r.mean_defect_rate, r.median_defect_rate, r.total_units)
           for r in quality.defect_stats_by_product(ins, digits=6).collect()}
    assert got == {None: (0.02, 0.02, 20), "P": (0.02, 0.02, 10)}


def test_sample_is_the_same_for_integer_and_text_keys(spark):
    rows = [(o, ln, o % 7) for o in range(1, 400) for ln in (1, 2)]
    ints = spark.createDataFrame(rows, "order_id long, line_number int, supplier_id long")
    texts = ints.select(F.col("order_id").cast("string"), F.col("line_number").cast("string"), "supplier_id")
    a = [tuple(map(str, r)) for r in suppliers.sample_supplier_ids(ints, n=50).collect()]
    b = [tuple(map(str, r)) for r in suppliers.sample_supplier_ids(texts.repartition(7), n=50).collect()]
    assert sorted(a) == sorted(b) and len(a) == 50


def test_average_order_value_ignores_missing_revenue(spark):
    heads = orders(spark, [dict(order_id=1, revenue=Decimal("100.00")), dict(order_id=2, revenue=None)])
    heads = heads.withColumn("plant", F.lit("X")).withColumn("customer", F.lit("c"))
    r = plant.plant_efficiency(heads, _insp(spark, [dict(batch_size=10, defects_found=Decimal("1"))])).first()
    assert r.avg_order_value == 100.0 and r.total_revenue == 100.0 and r.total_orders == 2


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_sum_with_nulls_is_that_of_sql(spark, coalesce):
    rows = [("a", 5), ("b", None), ("c", 7), ("d", None), ("e", -2), ("f", 0), ("g", 11)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    order = [F.col("v").desc_nulls_last(), F.col("k").asc()]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, coalesce)
    try:
        got = {r.k: r.run for r in running_sum(df, "v", "v", "run", descending=True, ties=["k"]).collect()}
        only = running_sum(df.where("v is null"), "v", "v", "run", descending=True, ties=["k"]).collect()
        r = revenue.revenue_by_customer(orders(spark, [dict(customer="a", revenue=Decimal("21.00")),
                                                       dict(customer="b", revenue=None)])).collect()
    finally:
        spark.conf.set(key, before)
    want = {r.k: r.run for r in df.withColumn(
        "run", F.sum("v").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).collect()}
    assert got == want and {x.run for x in only} == {None}
    assert {x.customer: x.running_total for x in r} == {"a": 21.0, "b": 21.0}


def test_defect_rate_sd_of_close_rates(spark):
    ins = spark.createDataFrame([("P", 10, Decimal("1"), Decimal("0.0101"), "a", 1), ("P", 10, Decimal("1"), Decimal("0.0102"), "b", 1)],
                                "product string, batch_size int, defects_found decimal(10,4), defect_rate decimal(6,4), "
                                "inspection_id string, passed int")
    assert quality.defect_stats_by_product(ins).first().sd_defect_rate == pytest.approx(7.0710678e-05, rel=1e-6)


def test_pvalues_of_short_series_are_null(spark):
    for months in (1, 2):
        o = orders(spark, [dict(order_date=D(2023, m, 1), revenue=Decimal(m)) for m in range(1, months + 1)])
        assert [r.p_value for r in stats.revenue_trend_pvalues(o).collect()] == [None, None]


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10, 41, 78])
def test_t_pvalue_against_numeric_integration(spark, df):
    import math

    import numpy as np

    for t in (0.0, 0.3, 1.0, 2.5, 6.0):
        n = 200_001
        x = np.linspace(0, t, n)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        want = 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)
        got = spark.createDataFrame([(t, df)], "t double, df int").select(
            stats.two_sided_t_pvalue(F.col("t"), F.col("df")).alias("p")).first().p
        assert got == pytest.approx(want, abs=1e-8)


def test_decimal_conformity_sees_digits_after_the_point(spark):
    df = spark.createDataFrame([(0.12345,), (0.123,), (123.0,), (None,)], "x double")
    assert checks.decimal_conformity(df, {"x": (5, 3)}, "t").first().non_conforming == 2


def test_network_counts_customers_without_suppliers(spark):
    o = orders(spark, [dict(customer="a", supplier_id=1), dict(customer="b", supplier_id=None),
                       dict(customer="a", supplier_id=2), dict(customer="a", supplier_id=1)])
    r = network.network_stats(o).first()
    assert (r.num_suppliers, r.num_customers, r.num_edges, r.num_nodes, r.avg_degree) == (2, 2, 2, 4, 1.0)

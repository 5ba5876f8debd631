"""Named queries: each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the driver's test tables (whole tables, no row caps; a LIMIT appears only
where the top-k or the sample *is* the feature)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chainlens.functions import constants as K
from chainlens.functions import sqlrules
from chainlens.functions.numeric import as_double
from chainlens.operators import (checks, cohort, constraints, dashboard, distinct, documents, events, feedback, incremental, network,
                                 plant, quality, revenue, rolling, sketches, sla, stats, suppliers)
from chainlens.sources import readers
from chainlens.sources import testdata as td
from chainlens.sources.testdata import Tables

Query = Callable[[SparkSession, str], DataFrame]
DELIVERED = K.DELIVERED

# Cut-offs chosen on the test data so that its classes are all non-empty (the
# default thresholds put every product/plant in RED and no machine in GREEN).
# The *_cutoffs queries are extra variants for the class rules, not analyses of
# their own.
DEFECT_CUTOFFS = (3.97, 4.02)
OEE_CUTOFFS = (0.76, 0.73)
CRITICAL_BY_KEY_MIN = 200


DATABASE_CONF = "spark.chainlens.database"


def _t(spark, sf_dir) -> Tables:
    """Test tables; when the session names a database holding the bucketed fact tables
    (``spark.chainlens.database``, see ``chainlens.sources.layout``) they are read from it."""
    return Tables(spark, sf_dir, database=spark.conf.get(DATABASE_CONF, None) or None)


def _lines(t, status=DELIVERED, dims=td.ALL_DIMS):
    return td.orders_lines(t, status=status, dims=dims)


def _totals(t, status=DELIVERED, dims=()):
    """Per-order totals (lines combined before the orders join) for order-level analyses."""
    return td.order_totals(t, status=status, dims=dims)


def _events(t, types=None):
    return events.flatten_events(td.machine_events(t, types))


def _feedback_flat(t):
    return feedback.flatten_feedback(td.customer_feedback(t))


def _daily(t):
    return revenue.daily_revenue(_totals(t))


def _rolling(t):
    return rolling.rolling_revenue(_daily(t))


def _edges(t, customer="customer"):
    dims = ("customer",) if customer == "customer" else ()
    return network.supplier_edges(_lines(t, dims=dims), customer)


def _oee(t, cutoffs=(K.OEE_GREEN_FROM, K.OEE_AMBER_FROM)):
    return events.oee_by_machine(_events(t, "cycle_complete"), *cutoffs)


def _sample(t):
    # an order line is a row of the line items, whether or not its order is known: no join
    lines = t["lineitem"].select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
                                 F.col("l_suppkey").alias("supplier_id"))
    return suppliers.sample_supplier_ids(lines)


def _supplier_agg(t):
    return suppliers.supplier_aggregate(_lines(t, dims=()), td.suppliers(t))


def q_revenue_by_customer(spark, d):
    return revenue.revenue_by_customer(_totals(_t(spark, d), dims=("customer",)))


def q_revenue_by_customer_key(spark, d):
    # Same analysis per customer key: thousands of rows through the distributed running total.
    return revenue.revenue_by_customer(_totals(_t(spark, d)), customer="c_custkey")


def q_revenue_by_customer_share(spark, d):
    return revenue.revenue_share_by_customer(_totals(_t(spark, d), dims=("customer",)))


def q_supplier_scorecard(spark, d):
    t = _t(spark, d)
    return suppliers.supplier_scorecard(td.suppliers(t), _lines(t, status=None, dims=()))


def q_supplier_scorecard_top10(spark, d):
    t = _t(spark, d)
    return suppliers.supplier_scorecard_top(td.suppliers(t), _lines(t, status=None, dims=()))


def q_monthly_revenue_mom(spark, d):
    return revenue.monthly_revenue_mom(_totals(_t(spark, d)))


def q_monthly_revenue_orders(spark, d):
    return revenue.monthly_revenue_orders(_totals(_t(spark, d)))


def q_defects_by_product_plant(spark, d):
    return quality.defects_by_product_plant(td.inspection_totals(_t(spark, d)))


def q_defects_by_product_plant_rounded(spark, d):
    return quality.defects_by_product_plant_rounded(td.inspection_totals(_t(spark, d)))


def q_defects_by_product_plant_cutoffs(spark, d):
    return quality.defects_by_product_plant(td.inspection_totals(_t(spark, d)), *DEFECT_CUTOFFS)


def q_defects_by_product_plant_rounded_cutoffs(spark, d):
    return quality.defects_by_product_plant_rounded(td.inspection_totals(_t(spark, d)), *DEFECT_CUTOFFS)


def q_top_products_per_customer(spark, d):
    return revenue.top_products_per_customer(_lines(_t(spark, d), dims=("customer", "product")))


def q_top_products_per_customer_by_key(spark, d):
    return revenue.top_products_per_customer(_lines(_t(spark, d), dims=("product",)), customer="c_custkey")


def q_customer_months(spark, d):
    return cohort.customer_months_out(_totals(_t(spark, d), dims=("customer",)))


def q_customer_cohort(spark, d):
    return cohort.customer_cohort(_totals(_t(spark, d)), customer="c_custkey")


def q_customer_cohort_segment(spark, d):
    return cohort.customer_cohort(_totals(_t(spark, d), dims=("customer",)))


def q_customer_cohort_all_status(spark, d):
    return cohort.customer_cohort(_totals(_t(spark, d), status=None), customer="c_custkey", status=None)


def q_plant_efficiency(spark, d):
    t = _t(spark, d)
    return plant.plant_efficiency(td.order_heads(t, DELIVERED), td.inspections(t, dims=()))


def q_plant_efficiency_slim(spark, d):
    t = _t(spark, d)
    return plant.plant_efficiency(td.order_heads(t, DELIVERED), td.inspections(t, dims=()), slim=True)


def q_plant_efficiency_dedup(spark, d):
    t = _t(spark, d)
    return plant.plant_efficiency(td.order_heads(t, DELIVERED), td.inspections(t, dims=()), dedupe_orders=True)


def q_events_flat(spark, d):
    return _events(_t(spark, d))


def q_oee_by_machine(spark, d):
    return _oee(_t(spark, d))


def q_oee_by_machine_cutoffs(spark, d):
    return _oee(_t(spark, d), OEE_CUTOFFS)


def q_oee_bottom5(spark, d):
    # Preview of the worst machines: the sorted result's first rows (TakeOrderedAndProject).
    return _oee(_t(spark, d)).limit(5)


def q_downtime_by_plant(spark, d):
    return events.downtime_by_plant(_events(_t(spark, d), "downtime_start"))


def q_top_alerts(spark, d):
    return events.top_alerts(_events(_t(spark, d), "alert"))


def q_sensor_anomaly_flags(spark, d):
    return events.sensor_anomaly_flags(_events(_t(spark, d)))


def q_sensor_anomaly_totals(spark, d):
    return events.sensor_anomaly_totals(events.sensor_anomaly_flags(_events(_t(spark, d))))


def q_feedback_flat(spark, d):
    return _feedback_flat(_t(spark, d))


def q_sentiment_by_customer(spark, d):
    return feedback.sentiment_by_customer(_feedback_flat(_t(spark, d)))


def q_sentiment_top5(spark, d):
    s = feedback.sentiment_by_customer(_feedback_flat(_t(spark, d)))
    return s.select("customer", "total", "neg_rate").limit(5)


def q_tag_top5(spark, d):
    return feedback.tag_frequency(td.customer_feedback(_t(spark, d))).limit(5)


def q_tag_frequency(spark, d):
    return feedback.tag_frequency(td.customer_feedback(_t(spark, d)))


def q_tag_frequency_sparse(spark, d):
    # documents whose only possible tag is "clean": the others count one empty tag each
    return feedback.tag_frequency(td.customer_feedback(_t(spark, d), sparse_tags=True))


def q_resolution_summary(spark, d):
    return feedback.resolution_summary(_feedback_flat(_t(spark, d)))


def q_orders_enriched(spark, d):
    t = _t(spark, d)
    return suppliers.enrich_orders(_lines(t, dims=("customer",)), td.suppliers(t, dims=()))


def q_sampled_supplier_ids(spark, d):
    return _sample(_t(spark, d))


def q_supplier_lookup(spark, d):
    t = _t(spark, d)
    return suppliers.lookup_suppliers(_sample(t), td.suppliers(t, dims=()))


def q_top_customers(spark, d):
    return revenue.top_customers(_totals(_t(spark, d), dims=("customer",)))


def q_top_customers_by_key(spark, d):
    return revenue.top_customers(_totals(_t(spark, d)), customer="c_custkey")


def q_daily_revenue(spark, d):
    return _daily(_t(spark, d)).select("date", as_double("revenue").alias("revenue"))


def q_rolling_30d_revenue(spark, d):
    return _rolling(_t(spark, d))


def q_rolling_summary(spark, d):
    return rolling.rolling_summary(_rolling(_t(spark, d)))


def q_sla_breach(spark, d):
    return sla.sla_breach(_lines(_t(spark, d), dims=()))


def q_lead_time_stats(spark, d):
    return sla.lead_time_stats(_lines(_t(spark, d), dims=()))


def q_supplier_adjacency(spark, d):
    return network.supplier_adjacency(_edges(_t(spark, d)))


def q_supplier_edges(spark, d):
    return _edges(_t(spark, d))


def q_supplier_edges_by_key(spark, d):
    return _edges(_t(spark, d), "c_custkey")


def q_network_stats(spark, d):
    return network.network_stats(_lines(_t(spark, d), dims=("customer",)))


def q_network_stats_by_key(spark, d):
    return network.network_stats(_lines(_t(spark, d), dims=()), "c_custkey")


def q_critical_suppliers(spark, d):
    return network.critical_suppliers(_edges(_t(spark, d)))


def q_critical_suppliers_by_key(spark, d):
    return network.critical_suppliers(_edges(_t(spark, d), "c_custkey"), CRITICAL_BY_KEY_MIN, with_customers=False)


def q_supplier_dependency(spark, d):
    t = _t(spark, d)
    return network.supplier_dependency(_edges(t), td.suppliers(t, dims=()))


def q_supplier_dependency_by_key(spark, d):
    t = _t(spark, d)
    return network.supplier_dependency(_edges(t, "c_custkey"), td.suppliers(t, dims=()))


def q_revenue_summary(spark, d):
    return stats.revenue_summary(_lines(_t(spark, d), dims=()))


def q_lead_time_summary(spark, d):
    return stats.lead_time_summary(_lines(_t(spark, d), dims=()))


def q_supplier_aggregate(spark, d):
    return _supplier_agg(_t(spark, d))


def q_supplier_correlations(spark, d):
    return stats.supplier_correlations(_supplier_agg(_t(spark, d)))


def q_defect_stats_by_product(spark, d):
    return quality.defect_stats_by_product(
        td.inspection_totals(_t(spark, d), dims=("product",), by_rate=True), digits=6)


def q_monthly_trend(spark, d):
    return stats.monthly_trend(_totals(_t(spark, d)))


def q_revenue_trend_ols(spark, d):
    return stats.revenue_trend_ols(_totals(_t(spark, d)))


def q_revenue_trend_fit(spark, d):
    return stats.revenue_trend_fit(_totals(_t(spark, d)))


def q_revenue_trend_pvalues(spark, d):
    return stats.revenue_trend_pvalues(_totals(_t(spark, d)))


def q_panel_monthly(spark, d):
    return dashboard.panel_monthly(revenue.monthly_revenue_orders(_totals(_t(spark, d))))


def q_panel_oee(spark, d):
    return dashboard.panel_oee(_oee(_t(spark, d)))


def q_panel_defects(spark, d):
    return dashboard.panel_defects(quality.defect_pct_by_product(
        td.inspection_totals(_t(spark, d), dims=("product",))))


def q_panel_rolling(spark, d):
    return dashboard.panel_rolling(_rolling(_t(spark, d)))


def q_panel_customers(spark, d):
    return dashboard.panel_customers(_totals(_t(spark, d), dims=("customer",)))


def q_kpi_table(spark, d):
    t = _t(spark, d)
    return dashboard.kpi_table(_totals(t), td.inspections(t, dims=()), _oee(t))


def q_net_revenue(spark, d):
    t = _t(spark, d)
    price = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("unit_price"))
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return li.join(price, "l_partkey", "left").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
        as_double("l_quantity").alias("quantity"), as_double("unit_price").alias("unit_price"),
        as_double("l_discount").alias("discount_pct"),
        as_double(revenue.net_revenue("l_quantity", "unit_price", "l_discount")).alias("net_revenue"))


def q_sql_status_summary(spark, d):
    # the same engine through SQL text over registered views
    t = _t(spark, d)
    readers.register(t["orders"], "chainlens_orders")
    return readers.run_sql(spark, """
        SELECT o_orderstatus AS status_code, COUNT(*) AS orders,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS revenue
        FROM chainlens_orders GROUP BY o_orderstatus ORDER BY revenue DESC""")


def q_row_defect_rate(spark, d):
    return quality.row_defect_rate(td.inspections(_t(spark, d), dims=()))


def q_check_pk(spark, d):
    t = _t(spark, d)
    return (checks.check_pk(td.order_heads(t, dims=()), "order_id", "orders")
            .unionByName(checks.check_pk(td.suppliers(t, dims=()), "supplier_id", "suppliers"))
            # inspection_id is "order_id-line_number": check the integer pair, text only for hits
            .unionByName(checks.check_pk(td.inspections(t, dims=()), ["order_id", "line_number"],
                                         "quality_inspections")))


def q_check_fk(spark, d):
    t = _t(spark, d)
    # each relation on its own two tables: a line's order must not decide whether its supplier is checked
    return (checks.check_fk(t["lineitem"], "l_suppkey", t["supplier"], "s_suppkey", "orders.supplier_id->suppliers")
            .unionByName(checks.check_fk(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey",
                                         "quality_inspections.order_id->orders")))


def q_check_not_null(spark, d):
    t = _t(spark, d)
    return (checks.check_not_null(td.suppliers(t, dims=()), ["supplier_name"], "suppliers")
            .unionByName(checks.check_not_null(td.order_heads(t, dims=()), ["order_date"], "orders")))


def q_check_enum(spark, d):
    t = _t(spark, d)
    return (checks.check_enum(td.suppliers(t, dims=()), "tier", K.SUPPLIER_TIERS, "suppliers")
            .unionByName(checks.check_enum(td.order_heads(t, dims=()), "status", K.ORDER_STATUSES, "orders"))
            .unionByName(checks.check_enum(td.machine_events(t), "event_type", K.EVENT_TYPES, "machine_events")))


def q_defaults_filled(spark, d):
    heads = td.order_heads(_t(spark, d)).select("order_id", "customer", "plant",
                                                as_double("revenue").alias("revenue"), "status")
    return checks.apply_defaults(heads, "orders")


def q_defaults_suppliers(spark, d):
    # the declared defaults fill tier and active, in their declared types
    s = td.suppliers(_t(spark, d), dims=()).select("supplier_id", "supplier_name")
    return checks.apply_defaults(s, "suppliers")


def q_defaults_inspections(spark, d):
    i = td.inspections(_t(spark, d), dims=()).select("order_id", "inspection_id", "batch_size")
    return checks.apply_defaults(i, "quality_inspections")


def q_table_row_counts(spark, d):
    # the base tables: one order line and one inspection per line item
    t = _t(spark, d)
    return checks.row_counts({"orders": t["lineitem"], "suppliers": t["supplier"], "quality_inspections": t["lineitem"],
                              "machine_events": t["events"], "customer_feedback": t["documents"]})


def q_table_row_counts_footer(spark, d):
    return checks.footer_counts(spark, {name: f"{d.rstrip('/')}/{table}.parquet" for name, table in (
        ("orders", "lineitem"), ("suppliers", "supplier"), ("quality_inspections", "lineitem"),
        ("machine_events", "events"), ("customer_feedback", "documents"))})


def line_rules(t: Tables) -> constraints.Rules:
    """All declared constraints of a line item (an order line and its inspection)."""
    return constraints.Rules(
        "lineitem", ("l_orderkey", "l_linenumber"),
        {"l_suppkey": (t["supplier"], "s_suppkey"), "l_orderkey": (t["orders"], "o_orderkey")},
        ("l_orderkey", "l_shipdate", "l_quantity"), {"l_returnflag": ("R", "A"), "l_linestatus": ("O", "F")},
        {"l_extendedprice": (10, 2), "l_discount": (5, 3), "l_tax": (6, 4), "l_quantity": (4, 0)})


def q_constraint_report(spark, d):
    # every rule of the line items from one scan of them
    t = _t(spark, d)
    return constraints.constraint_report(t["lineitem"], line_rules(t))


def q_check_fk_bitmaps(spark, d):
    t = _t(spark, d)
    return (constraints.check_reference_by_bitmaps(t["lineitem"], "l_suppkey", t["supplier"], "s_suppkey",
                                                   "orders.supplier_id->suppliers")
            .unionByName(constraints.check_reference_by_bitmaps(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey",
                                                                "quality_inspections.order_id->orders")))


def q_supplier_scorecard_sql(spark, d):
    # the scorecard as SQL text over views, with the rules as SQL functions and a parameter marker
    t = _t(spark, d)
    sqlrules.register_rules(spark)
    readers.register(td.suppliers(t), "cl_suppliers")
    readers.register(_lines(t, status=None, dims=()), "cl_orders")
    return readers.run_sql(spark, sqlrules.SCORECARD, {"active": 1})


def q_decimal_conformity(spark, d):
    li = _t(spark, d)["lineitem"]
    spec = {"l_extendedprice": (10, 2), "l_discount": (5, 3), "l_tax": (6, 4), "l_quantity": (4, 0)}
    return checks.decimal_conformity(li, spec, "lineitem")


def q_events_flat_variant(spark, d):
    # the documents as JSON text, parsed once each to VARIANT and read by path
    docs = td.machine_events(_t(spark, d))
    parsed = documents.parse_documents(td.document_texts(docs, F.struct(F.col("plant").alias("plant"))))
    return events.flatten_events(documents.structured(parsed, td.document_schema(docs)))


def q_feedback_flat_variant(spark, d):
    docs = td.customer_feedback(_t(spark, d))
    parsed = documents.parse_documents(td.document_texts(docs))
    return feedback.flatten_feedback(documents.structured(parsed, td.document_schema(docs)))


def q_document_unknown_keys(spark, d):
    # feedback documents against a schema that declares neither their tags nor the resolution's owner
    docs = td.customer_feedback(_t(spark, d))
    parsed = documents.parse_documents(td.document_texts(docs))
    known = StructType([StructField(f.name, StructType([x for x in f.dataType.fields if x.name != "owner"]))
                        if f.name == "resolution" else f for f in docs.schema.fields if f.name != "tags"])
    return documents.unknown_key_summary(documents.unknown_keys(parsed, known, "$.feedback_id"))


SKETCH_PROBS, SKETCH_NAMES = (0.25, 0.5, 0.75, 0.95), ("q1", "median", "q3", "p95")


def _revenue_sketches(t):
    return sketches.value_sketches(_lines(t, dims=()), ["order_date"], "revenue")


def _year_sketches(t):
    return sketches.roll_up(_revenue_sketches(t), [F.year("order_date").alias("year")])


def q_revenue_sketch_audit(spark, d):
    # exact counts and extremes from the same sketch rows, and whether each quantile's true rank is within 2 %
    t = _t(spark, d)
    q = sketches.sketch_quantiles(_year_sketches(t), SKETCH_PROBS, SKETCH_NAMES)
    facts = _lines(t, dims=()).withColumn("year", F.year("order_date"))
    off = sketches.rank_errors(facts, q, ["year"], "revenue", SKETCH_PROBS, SKETCH_NAMES)
    ok = off.select(F.col("year").alias("_y"), *[(F.col(n) <= 0.02).alias(f"{n}_within") for n in SKETCH_NAMES])
    return (q.join(ok, F.col("year").eqNullSafe(F.col("_y"))).select(
        F.col("year").cast("long").alias("year"), F.col("n").alias("lines"), as_double("total").alias("total_revenue"),
        as_double("smallest").alias("smallest"), as_double("largest").alias("largest"),
        *[f"{n}_within" for n in SKETCH_NAMES]).orderBy("year"))


def q_distinct_customers_calendar(spark, d):
    return distinct.calendar_distinct(revenue.delivered(td.order_heads(_t(spark, d), DELIVERED, dims=())),
                                      "order_date", "c_custkey", "customers")


def q_distinct_parties_by_month(spark, d):
    # several distinct counts per group from bitmaps: no row is expanded for the shuffle
    lines = _lines(_t(spark, d), dims=()).withColumn("month", F.date_format("order_date", "yyyy-MM"))
    return distinct.distinct_columns(lines, ["month"], {"customers": "c_custkey", "suppliers": "supplier_id",
                                                         "orders": "order_id"}).orderBy("month")


def _incremental_days(t):
    load, gone, fresh = td.corrected_lines(t)
    state = incremental.daily_changes(load)
    return incremental.days(incremental.merge(state, incremental.daily_changes(incremental.signed(gone, -1)),
                                              incremental.daily_changes(incremental.signed(fresh, 1))))


def q_monthly_revenue_incremental(spark, d):
    return revenue.monthly_revenue_mom(_incremental_days(_t(spark, d)))


def q_rolling_30d_incremental(spark, d):
    return rolling.rolling_revenue(revenue.daily_revenue(_incremental_days(_t(spark, d))))


QUERIES: dict[str, Query] = {name[2:]: fn for name, fn in list(globals().items())
                             if name.startswith("q_") and callable(fn)}

"""The analyses over the domain's own files.

Input layout (one folder): ``orders.csv``, ``suppliers.csv``,
``quality_inspections.csv`` (headed CSV, declared schemas) and
``machine_events.json``, ``customer_feedback.json`` (nested documents, one JSON
array per file or JSON Lines).  Every entry of :data:`DOMAIN_QUERIES` takes the
loaded :class:`Domain` and returns a lazy DataFrame — the same operators the
test-table registry uses, bound to these inputs instead of the adapters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chainlens.functions import constants as K
from chainlens.functions.numeric import as_double
from chainlens.operators import (checks, cohort, dashboard, events, feedback, network, plant, quality, revenue,
                                 rolling, sla, stats, suppliers)
from chainlens.sources import readers, schemas

FILES = {"orders": "orders.csv", "suppliers": "suppliers.csv", "quality_inspections": "quality_inspections.csv",
         "machine_events": "machine_events.json", "customer_feedback": "customer_feedback.json"}


@dataclass
class Domain:
    spark: SparkSession
    data_dir: str
    orders: DataFrame
    suppliers: DataFrame
    inspections: DataFrame
    event_docs: DataFrame
    feedback_docs: DataFrame

    @property
    def events(self) -> DataFrame:
        return events.flatten_events(self.event_docs)

    @property
    def feedback(self) -> DataFrame:
        return feedback.flatten_feedback(self.feedback_docs)

    def raw_csv(self, table: str) -> DataFrame:
        """The CSV as text columns (for conformity checks before any cast)."""
        return self.spark.read.option("header", True).csv(f"{self.data_dir}/{FILES[table]}")


def load(spark: SparkSession, data_dir: str, json_lines: bool = True) -> Domain:
    d = data_dir.rstrip("/")
    return Domain(
        spark, d,
        readers.read_csv(spark, f"{d}/{FILES['orders']}", "orders"),
        readers.read_csv(spark, f"{d}/{FILES['suppliers']}", "suppliers"),
        readers.read_csv(spark, f"{d}/{FILES['quality_inspections']}", "quality_inspections"),
        readers.read_documents(spark, f"{d}/{FILES['machine_events']}", "machine_events", multi_line=not json_lines),
        readers.read_documents(spark, f"{d}/{FILES['customer_feedback']}", "customer_feedback",
                               multi_line=not json_lines))


def _declared_decimals(table: str) -> dict:
    from pyspark.sql.types import DecimalType

    return {f.name: (f.dataType.precision, f.dataType.scale) for f in schemas.BY_NAME[table].fields
            if isinstance(f.dataType, DecimalType)}


def _oee(d: Domain) -> DataFrame:
    return events.oee_by_machine(d.events)


def _rolling(d: Domain) -> DataFrame:
    return rolling.rolling_revenue(revenue.daily_revenue(d.orders))


def _sample(d: Domain) -> DataFrame:
    return suppliers.sample_supplier_ids(d.orders)


DOMAIN_QUERIES: dict[str, Callable[[Domain], DataFrame]] = {
    "revenue_by_customer": lambda d: revenue.revenue_by_customer(d.orders),
    "revenue_by_customer_share": lambda d: revenue.revenue_share_by_customer(d.orders),
    "supplier_scorecard": lambda d: suppliers.supplier_scorecard(d.suppliers, d.orders),
    "supplier_scorecard_top10": lambda d: suppliers.supplier_scorecard_top(d.suppliers, d.orders),
    "monthly_revenue_mom": lambda d: revenue.monthly_revenue_mom(d.orders),
    "monthly_revenue_orders": lambda d: revenue.monthly_revenue_orders(d.orders),
    "defects_by_product_plant": lambda d: quality.defects_by_product_plant(d.inspections),
    "defects_by_product_plant_rounded": lambda d: quality.defects_by_product_plant_rounded(d.inspections),
    "top_products_per_customer": lambda d: revenue.top_products_per_customer(d.orders),
    "customer_months": lambda d: cohort.customer_months_out(d.orders),
    "customer_cohort": lambda d: cohort.customer_cohort(d.orders),
    "plant_efficiency": lambda d: plant.plant_efficiency(d.orders, d.inspections),
    "plant_efficiency_slim": lambda d: plant.plant_efficiency(d.orders, d.inspections, slim=True),
    "plant_efficiency_dedup": lambda d: plant.plant_efficiency(d.orders, d.inspections, dedupe_orders=True),
    "events_flat": lambda d: d.events,
    "oee_by_machine": _oee,
    "oee_bottom5": lambda d: _oee(d).limit(5),
    "downtime_by_plant": lambda d: events.downtime_by_plant(d.events),
    "top_alerts": lambda d: events.top_alerts(d.events),
    "sensor_anomaly_flags": lambda d: events.sensor_anomaly_flags(d.events),
    "sensor_anomaly_totals": lambda d: events.sensor_anomaly_totals(events.sensor_anomaly_flags(d.events)),
    "feedback_flat": lambda d: d.feedback,
    "sentiment_by_customer": lambda d: feedback.sentiment_by_customer(d.feedback),
    "tag_frequency": lambda d: feedback.tag_frequency(d.feedback_docs),
    "sentiment_top5": lambda d: feedback.sentiment_by_customer(d.feedback).select("customer", "total", "neg_rate").limit(5),
    "tag_top5": lambda d: feedback.tag_frequency(d.feedback_docs).limit(5),
    "resolution_summary": lambda d: feedback.resolution_summary(d.feedback),
    "orders_enriched": lambda d: suppliers.enrich_orders(d.orders, d.suppliers),
    "sampled_supplier_ids": _sample,
    "supplier_lookup": lambda d: suppliers.lookup_suppliers(_sample(d), d.suppliers),
    "top_customers": lambda d: revenue.top_customers(d.orders),
    "daily_revenue": lambda d: revenue.daily_revenue(d.orders).select("date", as_double("revenue").alias("revenue")),
    "rolling_30d_revenue": _rolling,
    "rolling_summary": lambda d: rolling.rolling_summary(_rolling(d)),
    "sla_breach": lambda d: sla.sla_breach(d.orders),
    "lead_time_stats": lambda d: sla.lead_time_stats(d.orders),
    "supplier_adjacency": lambda d: network.supplier_adjacency(network.supplier_edges(d.orders)),
    "supplier_edges": lambda d: network.supplier_edges(d.orders),
    "network_stats": lambda d: network.network_stats(d.orders),
    "critical_suppliers": lambda d: network.critical_suppliers(network.supplier_edges(d.orders)),
    "supplier_dependency": lambda d: network.supplier_dependency(network.supplier_edges(d.orders), d.suppliers),
    "revenue_summary": lambda d: stats.revenue_summary(d.orders),
    "lead_time_summary": lambda d: stats.lead_time_summary(d.orders),
    "supplier_aggregate": lambda d: suppliers.supplier_aggregate(d.orders, d.suppliers),
    "supplier_correlations": lambda d: stats.supplier_correlations(suppliers.supplier_aggregate(d.orders, d.suppliers)),
    "defect_stats_by_product": lambda d: quality.defect_stats_by_product(d.inspections),
    "monthly_trend": lambda d: stats.monthly_trend(d.orders),
    "revenue_trend_ols": lambda d: stats.revenue_trend_ols(d.orders),
    "revenue_trend_fit": lambda d: stats.revenue_trend_fit(d.orders),
    "revenue_trend_pvalues": lambda d: stats.revenue_trend_pvalues(d.orders),
    "panel_monthly": lambda d: dashboard.panel_monthly(revenue.monthly_revenue_orders(d.orders)),
    "panel_oee": lambda d: dashboard.panel_oee(_oee(d)),
    "panel_defects": lambda d: dashboard.panel_defects(quality.defect_pct_by_product(d.inspections)),
    "panel_rolling": lambda d: dashboard.panel_rolling(_rolling(d)),
    "panel_customers": lambda d: dashboard.panel_customers(d.orders),
    "kpi_table": lambda d: dashboard.kpi_table(d.orders, d.inspections, _oee(d)),
    "net_revenue": lambda d: d.orders.select(
        "order_id", "quantity", as_double("unit_price").alias("unit_price"),
        as_double("discount_pct").alias("discount_pct"), as_double("revenue").alias("recorded_revenue"),
        as_double(revenue.net_revenue("quantity", "unit_price", "discount_pct")).alias("net_revenue")),
    "row_defect_rate": lambda d: quality.row_defect_rate(d.inspections),
    "check_pk": lambda d: (checks.check_pk(d.orders, "order_id", "orders")
                           .unionByName(checks.check_pk(d.suppliers, "supplier_id", "suppliers"))
                           .unionByName(checks.check_pk(d.inspections, "inspection_id", "quality_inspections"))),
    "check_fk": lambda d: (checks.check_fk(d.orders, "supplier_id", d.suppliers, "supplier_id",
                                           "orders.supplier_id->suppliers")
                           .unionByName(checks.check_fk(d.inspections, "order_id", d.orders, "order_id",
                                                        "quality_inspections.order_id->orders"))),
    "check_not_null": lambda d: (checks.check_not_null(d.suppliers, ["supplier_name"], "suppliers")
                                 .unionByName(checks.check_not_null(d.orders, ["order_date"], "orders"))),
    "check_enum": lambda d: (checks.check_enum(d.suppliers, "tier", K.SUPPLIER_TIERS, "suppliers")
                             .unionByName(checks.check_enum(d.orders, "status", K.ORDER_STATUSES, "orders"))
                             .unionByName(checks.check_enum(d.event_docs, "event_type", K.EVENT_TYPES, "machine_events"))),
    "defaults_filled": lambda d: checks.apply_defaults(d.orders, "orders"),
    "table_row_counts": lambda d: checks.row_counts({"orders": d.orders, "suppliers": d.suppliers,
                                                     "quality_inspections": d.inspections,
                                                     "machine_events": d.event_docs,
                                                     "customer_feedback": d.feedback_docs}),
    "decimal_conformity": lambda d: (checks.decimal_conformity(d.raw_csv("suppliers"), _declared_decimals("suppliers"), "suppliers")
                                     .unionByName(checks.decimal_conformity(d.raw_csv("orders"), _declared_decimals("orders"), "orders"))
                                     .unionByName(checks.decimal_conformity(d.raw_csv("quality_inspections"),
                                                                            _declared_decimals("quality_inspections"),
                                                                            "quality_inspections"))),
}

"""Dashboard datasets: the data behind each chart panel and the KPI table.
Rendering is out of scope; every panel is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.classify import chart_defect_colour, growth_sign_class
from chainlens.functions.dates import month_label
from chainlens.functions.numeric import ratio, round_half_up
from chainlens.operators.events import oee_by_machine
from chainlens.operators.quality import defect_pct_by_product, defect_rate_mean, with_inspection_weights
from chainlens.operators.revenue import (customer_revenue, daily_revenue, delivered, lead_mean,
                                         monthly_revenue_orders, order_count, with_order_weights)
from chainlens.operators.rolling import rolling_revenue
from chainlens.session import materialize


def panel_monthly(monthly: DataFrame) -> DataFrame:
    """From the monthly revenue/orders table: label, revenue in Mn, growth (NULL -> 0), sign class."""
    growth = F.coalesce(F.col("mom_growth_pct"), F.lit(0.0))
    return (monthly.select("month", month_label(F.to_date("month", "yyyy-MM")).alias("month_label"),
                           round_half_up(ratio("revenue", F.lit(K.MILLION)), 6).alias("revenue_mn"),
                           growth.alias("growth_pct"), growth_sign_class("mom_growth_pct").alias("growth_class"))
            .orderBy("month"))


def panel_oee(oee: DataFrame) -> DataFrame:
    """OEE % per machine with its RAG and the two chart reference lines."""
    return (oee.select("machine_id", round_half_up(F.col("avg_oee") * 100, 4).alias("oee_pct"), "oee_rag",
                       F.lit(K.OEE_CHART_LINES[0]).alias("world_class_line"),
                       F.lit(K.OEE_CHART_LINES[1]).alias("threshold_line"))
            .orderBy("oee_pct", "machine_id"))


def panel_defects(defect_pct: DataFrame) -> DataFrame:
    """Defect % per product with the chart colour rule (NULL -> GREEN) and reference lines."""
    return (defect_pct.select("product", round_half_up("defect_pct", 6).alias("defect_pct"),
                              chart_defect_colour("defect_pct").alias("colour"),
                              F.lit(K.DEFECT_CHART_LINES[0]).alias("red_line"),
                              F.lit(K.DEFECT_CHART_LINES[1]).alias("amber_line"))
            .orderBy("defect_pct", "product"))


def panel_rolling(rolling: DataFrame) -> DataFrame:
    """Rolling revenue in Mn per day and its overall mean.

    The series has one row per calendar day and the rolling frame already
    orders it in one partition, so the mean is a whole-series window over the
    same rows — no second pass over the orders.
    """
    mn = F.col("rolling_30d_revenue_mn").cast("decimal(20,3)")
    whole = Window.partitionBy()
    avg_mn = F.try_divide(F.sum(mn).over(whole).cast("double"), F.count(mn).over(whole).cast("double"))
    return (rolling.select("date", F.col("rolling_30d_revenue_mn").alias("rolling_mn"),
                           round_half_up(avg_mn, 6).alias("mean_mn"))
            .orderBy("date"))


def panel_customers(orders: DataFrame, top: int = K.HIGHLIGHT_TOP, customer: str = "customer") -> DataFrame:
    """Revenue in Mn per customer, the top ``top`` flagged.

    The top rows come from TakeOrderedAndProject (``top`` rows, a proven bound), so
    broadcasting them back onto the per-customer rows is safe; both branches
    share the aggregation's shuffle.
    """
    rev = customer_revenue(orders, customer)
    best = (rev.orderBy(F.col("revenue").desc_nulls_last(), F.col(customer)).limit(top)
            .select(F.col(customer).alias("_top"), F.lit(True).alias("_hit")))
    j = rev.join(F.broadcast(best), F.col(customer) == F.col("_top"), "left")
    return (j.select(customer, round_half_up(ratio("revenue", F.lit(K.MILLION)), 6).alias("revenue_mn"),
                     F.coalesce(F.col("_hit"), F.lit(False)).alias("highlight"))
            .orderBy("revenue_mn", customer))


def kpi_table(orders: DataFrame, insp: DataFrame, oee: DataFrame) -> DataFrame:
    """Six executive KPIs as rows: label, value, value_text, status.

    Each source is aggregated to one row in one pass; the three rows are put side
    by side and stacked with ``inline``.
    """
    d = delivered(orders).agg(
        ratio(F.sum("revenue"), F.lit(K.CRORE)).alias("total_cr"), order_count(orders).alias("n_orders"),
        lead_mean(orders).alias("avg_lead"))
    o = oee.agg((F.avg("avg_oee") * 100).alias("avg_oee"), F.count_if(F.col("oee_rag") == "RED").alias("red"))
    q = insp.agg((defect_rate_mean(insp) * 100).alias("avg_defect"))
    total_cr, n_orders, avg_lead, avg_oee, red, avg_defect = (
        F.col(c) for c in ("total_cr", "n_orders", "avg_lead", "avg_oee", "red", "avg_defect"))

    def fmt(pattern, value, digits):
        return F.format_string(pattern, round_half_up(value, digits))

    def row(label, value, text, status):
        return F.struct(F.lit(label).alias("label"), round_half_up(value, 4).alias("value"),
                        text.alias("value_text"), status.alias("status"))

    rows = F.array(
        row(K.KPI_LABELS[0], total_cr, fmt("₹%.1f Cr", total_cr, 1), F.lit("GREEN")),
        row(K.KPI_LABELS[1], n_orders, F.format_number(n_orders, 0), F.lit("BLUE")),
        row(K.KPI_LABELS[2], avg_oee, fmt("%.1f%%", avg_oee, 1),
            F.when(avg_oee >= K.KPI_OEE_GREEN_PCT, "GREEN").otherwise("AMBER")),
        row(K.KPI_LABELS[3], avg_defect, fmt("%.2f%%", avg_defect, 2),
            F.when(avg_defect < K.KPI_DEFECT_GREEN_BELOW_PCT, "GREEN").otherwise("AMBER")),
        row(K.KPI_LABELS[4], red, red.cast("string"),
            F.when(red > K.KPI_RED_MACHINES_ABOVE, "RED").otherwise("AMBER")),
        row(K.KPI_LABELS[5], avg_lead, fmt("%.1f days", avg_lead, 1),
            F.when(avg_lead <= K.KPI_LEAD_GREEN_MAX_DAYS, "GREEN").otherwise("AMBER")),
    )
    return d.crossJoin(F.broadcast(o)).crossJoin(F.broadcast(q)).select(F.inline(rows))  # one row each


_ORDER_SUMS = ("revenue", "line_count", "revenue_count", "lead_day_sum", "lead_day_count")


def dashboard_bundle(order_totals: DataFrame, insp: DataFrame, events_flat: DataFrame,
                     customer: str = "customer") -> dict[str, DataFrame]:
    """All six dashboard datasets from one pass over each source.

    Built separately, the panels would scan the orders four times, the
    inspections twice and the events twice.  Here:

    * one GROUPING SETS aggregate over the delivered per-order totals gives the
      per-day and the per-customer sums together (materialised; days and
      customers only) — monthly, rolling, customer and KPI figures derive from it;
    * one pass over the events gives OEE per machine (materialised);
    * one pass over the inspections gives per-product sums (materialised).

    The three small tables are checkpointed when the bundle is built (the one place
    in the library that runs jobs while building), because up to four datasets
    read each of them and are written one after the other.

    The same operators run on these partial sums: they read ``line_count`` /
    ``revenue_count`` / ``lead_day_*`` / ``defect_rate_*`` as weights, so every
    dataset equals the stand-alone panel query.
    """
    d = delivered(with_order_weights(order_totals))
    sums = [F.sum(c).alias(c) for c in _ORDER_SUMS]
    both = materialize(d.groupingSets([["order_date"], [customer]], "order_date", customer)
                       .agg(F.grouping_id().alias("_g"), *sums))
    status = F.lit(K.DELIVERED).alias("status")
    by_day = both.where(F.col("_g") == 1).select("order_date", *_ORDER_SUMS, status)
    by_customer = both.where(F.col("_g") == 2).select(customer, *_ORDER_SUMS, status)
    oee = materialize(oee_by_machine(events_flat))
    by_product = materialize(with_inspection_weights(insp).groupBy("product").agg(
        *[F.sum(c).alias(c) for c in ("defects_found", "batch_size", "defect_rate_sum", "defect_rate_count")]))
    rolling = rolling_revenue(daily_revenue(by_day))
    return {
        "panel_monthly": panel_monthly(monthly_revenue_orders(by_day)),
        "panel_oee": panel_oee(oee),
        "panel_defects": panel_defects(defect_pct_by_product(by_product)),
        "panel_rolling": panel_rolling(rolling),
        "panel_customers": panel_customers(by_customer, customer=customer),
        "kpi_table": kpi_table(by_day, by_product, oee),
    }

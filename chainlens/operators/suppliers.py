"""Supplier scorecards, lookups, seeded sampling and the supplier aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.classify import supplier_rag
from chainlens.functions.dates import lead_days
from chainlens.functions.numeric import as_double, as_long, ratio, round_half_up
from chainlens.operators.revenue import delivered

_SUPPLIER_COLS = ["supplier_id", "supplier_name", "tier", "country", "on_time_rate", "quality_score", "avg_lead_days"]


def _orders_per_supplier(orders: DataFrame) -> DataFrame:
    """One row per supplier from the order lines (aggregate *before* the join:
    the fact side is combined map-side and only supplier-grain rows meet the
    supplier table, instead of joining every line and grouping afterwards)."""
    ld = lead_days("delivery_date", "order_date")
    return (orders.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id")
            .agg(F.count("order_id").alias("_n"), F.sum("revenue").alias("_rev"),
                 F.sum(ld).alias("_lead_sum"), F.count(ld).alias("_lead_n")))


def _row_key(df: DataFrame) -> list[str]:
    """Columns that identify an order row: (order_id, line_number) for line-grain orders."""
    return [c for c in ("order_id", "line_number") if c in df.columns]


def _scorecard_base(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    s = suppliers.where(F.col("active") == 1).select(*_SUPPLIER_COLS)
    j = s.join(_orders_per_supplier(orders), "supplier_id", "left")
    return j.withColumn("_avg_lead", ratio("_lead_sum", "_lead_n"))


def supplier_scorecard(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    """Active suppliers (LEFT JOIN keeps those without orders; all statuses counted)
    with totals, actual vs contracted lead days and the supplier RAG."""
    j = _scorecard_base(suppliers, orders)
    return (j.select(
        "supplier_id", "supplier_name", "tier", "country",
        as_double("on_time_rate").alias("on_time_rate"), as_double("quality_score").alias("quality_score"),
        as_long(F.coalesce(F.col("_n"), F.lit(0))).alias("total_orders"),
        round_half_up("_rev", 2).alias("total_revenue"),
        round_half_up("_avg_lead", 1).alias("avg_actual_lead_days"),
        as_long("avg_lead_days").alias("contracted_lead_days"),
        round_half_up(F.col("_avg_lead") - F.col("avg_lead_days"), 1).alias("lead_day_variance"),
        supplier_rag("quality_score", "on_time_rate").alias("supplier_rag"))
        .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("supplier_id")))


def supplier_scorecard_top(suppliers: DataFrame, orders: DataFrame, limit: int = K.SCORECARD_LIMIT) -> DataFrame:
    """Script variant: on-time %, average lead days, top ``limit`` by revenue (ties by id)."""
    j = _scorecard_base(suppliers, orders)
    return (j.select(
        "supplier_id", "tier", "country",
        round_half_up(F.col("on_time_rate") * 100, 1).alias("on_time_pct"),
        as_double("quality_score").alias("quality_score"),
        as_long(F.coalesce(F.col("_n"), F.lit(0))).alias("total_orders"),
        round_half_up("_rev", 2).alias("total_revenue"),
        round_half_up("_avg_lead", 1).alias("avg_lead_days"),
        supplier_rag("quality_score", "on_time_rate").alias("supplier_rag"))
        .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("supplier_id")).limit(limit))


def enrich_orders(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Delivered lines + supplier tier / quality / on-time.

    Tier is 'Unknown' only when the supplier key has no match; a matched
    supplier whose tier is NULL stays NULL.  The planner broadcasts the
    supplier side only when its measured size is under the broadcast
    threshold, and sort-merge joins it otherwise.
    """
    s = suppliers.select(F.col("supplier_id").alias("_sid"), "tier", "quality_score", "on_time_rate")
    j = delivered(orders).join(s, F.col("supplier_id") == F.col("_sid"), "left")
    return j.select(
        *_row_key(orders), "supplier_id", "customer", as_double("revenue").alias("revenue"),
        F.when(F.col("_sid").isNull(), F.lit(K.UNKNOWN_TIER)).otherwise(F.col("tier")).alias("supplier_tier"),
        as_double("quality_score").alias("supplier_quality"), as_double("on_time_rate").alias("supplier_ontime"))


def sample_hash(cols, seed: int) -> "F.Column":
    """Seeded pseudo-random text key of the key columns: the first 16 hex digits of an MD5 over their text forms.

    One hash for integer and text keys (an order read from CSV gives the same
    key), and any SQL engine reproduces it.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 16)


def sample_supplier_ids(orders: DataFrame, n: int = K.SAMPLE_SIZE, seed: int = K.SAMPLE_SEED) -> DataFrame:
    """Seeded sample of ``n`` order lines (without replacement) -> their supplier ids.

    ``orderBy(hash).limit(n)`` is TakeOrderedAndProject: every task keeps its
    ``n`` smallest hashes, so the sample is stable under any partitioning.
    """
    o = orders.where(F.col("supplier_id").isNotNull())
    key = _row_key(orders)
    return (o.select(sample_hash(key, seed).alias("sample_key"), *key, "supplier_id")
            .orderBy("sample_key", *key, "supplier_id").limit(n))


def lookup_suppliers(lookups: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Batch point lookup: every lookup row with its supplier record (NULLs when absent)."""
    s = suppliers.select(F.col("supplier_id").alias("_sid"), "supplier_name", "tier", "quality_score", "on_time_rate")
    j = lookups.join(s, F.col("supplier_id") == F.col("_sid"), "left")
    return j.select(*lookups.columns, "supplier_name", "tier",
                    as_double("quality_score").alias("quality_score"), as_double("on_time_rate").alias("on_time_rate"))


def supplier_aggregate(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Delivered totals per supplier, then INNER JOIN the supplier attributes."""
    ld = lead_days("delivery_date", "order_date")
    agg = (delivered(orders).groupBy("supplier_id")
           .agg(F.sum("revenue").alias("_rev"), F.count(F.lit(1)).alias("order_count"), F.avg(ld).alias("_avg_lead")))
    j = agg.join(suppliers, "supplier_id")
    return j.select("supplier_id", "tier", "country", as_double("quality_score").alias("quality_score"),
                    as_double("on_time_rate").alias("on_time_rate"), as_double("_rev").alias("total_revenue"),
                    as_long("order_count").alias("order_count"), round_half_up("_avg_lead", 6).alias("avg_lead_days"))

"""Plant efficiency: delivered orders LEFT JOIN their inspections, per plant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.numeric import as_long, pct, ratio, round_half_up
from chainlens.operators.revenue import delivered


def plant_efficiency(order_heads: DataFrame, insp: DataFrame, dedupe_orders: bool = False,
                     slim: bool = False) -> DataFrame:
    """Per plant: distinct orders and customers, revenue, average order value,
    average inspection defect rate and failed batches.

    The written SQL joins orders to inspections 1:N and aggregates the fan-out,
    so an order with n inspections counts its revenue n times.  Here the
    inspections are first combined per order (map-side), joined 1:1, and the
    fan-out is reproduced with the weight ``greatest(n, 1)`` — same numbers,
    but the fact side never multiplies.  ``dedupe_orders=True`` gives the true
    revenue (weight 1) instead.
    """
    per_order = (insp.groupBy("order_id")
                 .agg(F.count(F.lit(1)).alias("_n"), F.sum("defect_rate").alias("_sdr"),
                      F.count("defect_rate").alias("_cdr"),
                      F.sum(F.when(F.col("passed") == 0, 1).otherwise(0)).alias("_failed")))
    heads = delivered(order_heads)
    j = heads.join(per_order, "order_id", "left")
    w = F.lit(1) if dedupe_orders else F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1))
    # Two COUNT(DISTINCT)s without an Expand and in one pass over the orders:
    # 1. one row per (plant, order, customer) — the join output is already
    #    hash-partitioned on order_id, which satisfies this grouping (no shuffle);
    # 2. a window over (plant, order) on the same partitioning marks one row per
    #    order, so distinct orders become a plain sum;
    # 3. one row per (plant, customer) (map-side combined, small shuffle), then
    #    distinct customers are a plain count per plant.
    lvl1 = (j.groupBy("plant", "order_id", "customer")
            # AVG(revenue) ignores orders without revenue, so they weigh nothing
            .agg(F.sum(F.col("revenue") * w).alias("_rev"), F.sum(F.when(F.col("revenue").isNotNull(), w)).alias("_w"), F.sum("_sdr").alias("_sdr"),
                 F.sum("_cdr").alias("_cdr"), F.sum("_failed").alias("_failed")))
    first = F.row_number().over(Window.partitionBy("plant", "order_id").orderBy("customer")) == 1
    lvl1 = lvl1.withColumn("_order", (first & F.col("order_id").isNotNull()).cast("long"))
    sums = [F.sum(c).alias(c) for c in ("_rev", "_w", "_sdr", "_cdr", "_failed")]
    lvl2 = lvl1.groupBy("plant", "customer").agg(F.sum("_order").alias("_orders"), *sums)
    g = lvl2.groupBy("plant").agg(F.sum("_orders").alias("total_orders"),
                                  F.count("customer").alias("unique_customers"), *sums)
    cols = [F.col("plant"), as_long("total_orders").alias("total_orders"),
            round_half_up("_rev", 2).alias("total_revenue")]
    if not slim:
        cols.append(round_half_up(ratio("_rev", "_w"), 2).alias("avg_order_value"))
    cols += [as_long("unique_customers").alias("unique_customers"),
             round_half_up(pct("_sdr", "_cdr"), 3).alias("avg_defect_rate_pct")]
    if not slim:
        cols.append(as_long(F.coalesce(F.col("_failed"), F.lit(0))).alias("failed_batches"))
    return g.select(*cols).orderBy(F.col("total_revenue").desc_nulls_last(), "plant")

"""Delivery SLA: breach counts and lead-time statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.dates import lead_days
from chainlens.functions.numeric import as_long, pct, round_half_up
from chainlens.functions.windows import exact_quantiles
from chainlens.operators.revenue import delivered


def delivered_lead_days(orders: DataFrame) -> DataFrame:
    return (delivered(orders).select(lead_days("delivery_date", "order_date").alias("lead_days"))
            .where(F.col("lead_days").isNotNull()))


def sla_breach(orders: DataFrame, threshold: int = K.SLA_THRESHOLD_DAYS) -> DataFrame:
    """One row: total, breaches (lead > threshold), breach %, within, within %.

    A single conditional aggregate (partial per task, then one merge): the
    sort + binary search of a single machine is not needed.
    """
    ld = delivered_lead_days(orders)
    g = ld.agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("lead_days") > threshold).alias("_b"),
               F.count_if(F.col("lead_days") <= threshold).alias("_w"))
    bp = pct("_b", "_t")
    return g.select(F.lit(threshold).cast("long").alias("threshold_days"), as_long("_t").alias("total"),
                    as_long("_b").alias("breaches"), round_half_up(bp, 4).alias("breach_pct"),
                    as_long("_w").alias("within_sla"), round_half_up(F.lit(100) - bp, 4).alias("within_pct"))


def lead_time_stats(orders: DataFrame, p: float = K.LEAD_TIME_PERCENTILE) -> DataFrame:
    """Mean lead days and the exact ``p`` percentile (linear interpolation)."""
    ld = delivered_lead_days(orders)
    q = exact_quantiles(ld, "lead_days", [p], ["_p"], mean_name="_mean")
    return q.select(round_half_up("_mean", 4).alias("avg_lead_days"), round_half_up("_p", 4).alias("p95_lead_days"))

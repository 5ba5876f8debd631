"""Rolling revenue over calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.dates import epoch_day
from chainlens.functions.numeric import as_double, as_long, mean, ratio, round_half_up


def rolling_revenue(daily: DataFrame, window_days: int = K.ROLLING_WINDOW_DAYS) -> DataFrame:
    """Sum over the days ``d - window_days .. d`` inclusive (a 30-day window spans
    31 calendar days: Jan 1 is inside Jan 31's frame, not Feb 1's).

    RANGE frame on the epoch day number.  The frame runs over one row per
    calendar day — bounded by the date range, so the single ordered partition
    stays small whatever the order volume.
    """
    w = Window.orderBy(epoch_day("date")).rangeBetween(-window_days, 0)
    roll = F.sum("revenue").over(w)
    return (daily.select("date", as_double("revenue").alias("revenue"),
                         round_half_up(roll, 2).alias("rolling_30d_revenue"),
                         round_half_up(ratio(roll, F.lit(K.MILLION)), 3).alias("rolling_30d_revenue_mn"))
            .orderBy("date"))


def rolling_summary(rolling: DataFrame) -> DataFrame:
    """Days in the series, peak and mean rolling revenue."""
    return rolling.agg(as_long(F.count(F.lit(1))).alias("n_days"),
                       round_half_up(F.max("rolling_30d_revenue"), 2).alias("peak_rolling_revenue"),
                       round_half_up(mean(F.col("rolling_30d_revenue").cast("decimal(24,2)")), 2).alias("avg_rolling_revenue"))

"""Descriptive statistics, correlation and the linear revenue trend."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.dates import lead_days, month_start
from chainlens.functions.numeric import as_double, as_long, round_half_up
from chainlens.functions.windows import exact_quantiles
from chainlens.operators.revenue import delivered

SUMMARY_NAMES = ["min", "q1", "median", "q3", "max"]


def six_number_summary(df: DataFrame, column, digits: int = 6) -> DataFrame:
    """Min, Q1, median, mean, Q3, max with linearly interpolated quartiles (R type 7).

    Exact and distributed (see :func:`exact_quantiles`); ``df.summary()`` is not
    used because its quartiles do not interpolate.
    """
    q = exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0], SUMMARY_NAMES, mean_name="mean")
    return q.select(*[round_half_up(n, digits).alias(n) for n in ["min", "q1", "median", "mean", "q3", "max"]])


def revenue_summary(orders: DataFrame) -> DataFrame:
    return six_number_summary(delivered(orders), "revenue")


def lead_time_summary(orders: DataFrame) -> DataFrame:
    d = delivered(orders).select(lead_days("delivery_date", "order_date").alias("lead_days"))
    return six_number_summary(d, "lead_days")


def _guarded_corr(x, y):
    """Pearson r over complete pairs; NULL (not an error) when either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.when((F.var_samp(xs) > 0) & (F.var_samp(ys) > 0), F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys)))


def supplier_correlations(supplier_agg: DataFrame, digits: int = 6) -> DataFrame:
    """r(quality_score, total_revenue) and r(on_time_rate, total_revenue)."""
    return supplier_agg.agg(
        round_half_up(_guarded_corr("quality_score", "total_revenue"), digits).alias("r_quality_revenue"),
        round_half_up(_guarded_corr("on_time_rate", "total_revenue"), digits).alias("r_ontime_revenue"))


def monthly_series(orders: DataFrame) -> DataFrame:
    """Delivered revenue per month start (DATE) with its 1-based index ``t``.

    ``row_number`` runs over one row per calendar month — bounded by the range.
    """
    m = delivered(orders).groupBy(month_start("order_date").alias("month")).agg(F.sum("revenue").alias("revenue"))
    return m.withColumn("t", F.row_number().over(Window.orderBy("month")))


def monthly_trend(orders: DataFrame) -> DataFrame:
    m = monthly_series(orders)
    return m.select("month", as_double("revenue").alias("revenue"), as_long("t").alias("t")).orderBy("month")


def _ols_moments(orders: DataFrame) -> DataFrame:
    """Exact sums for revenue ~ t (DECIMAL arithmetic, so no summation-order noise),
    then the closed-form least-squares quantities in DOUBLE."""
    m = monthly_series(orders)
    y, t = F.col("revenue"), F.col("t").cast("long")
    s = m.agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"),
              F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(y * t).alias("sty"))
    n = F.col("n")
    s = s.select(
        as_double("n").alias("n"), as_double("st").alias("st"), as_double("sy").alias("sy"),
        as_double(n * F.col("stt") - F.col("st") * F.col("st")).alias("sxx_n"),
        as_double(n * F.col("sty") - F.col("st") * F.col("sy")).alias("sxy_n"),
        as_double(n * F.col("syy") - F.col("sy") * F.col("sy")).alias("syy_n"))
    slope = F.try_divide(F.col("sxy_n"), F.col("sxx_n"))
    s = s.withColumn("slope", slope)
    s = s.withColumn("intercept", F.try_divide(F.col("sy") - F.col("slope") * F.col("st"), F.col("n")))
    s = s.withColumn("r_squared", F.try_divide(F.col("sxy_n") * F.col("sxy_n"), F.col("sxx_n") * F.col("syy_n")))
    sse = F.try_divide(F.col("syy_n") - F.col("slope") * F.col("sxy_n"), F.col("n"))
    s = s.withColumn("sigma2", F.try_divide(sse, F.col("n") - F.lit(2.0)))
    s = s.withColumn("se_slope", F.sqrt(F.try_divide(F.col("sigma2") * F.col("n"), F.col("sxx_n"))))
    s = s.withColumn("se_intercept", F.sqrt(F.col("sigma2") * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(
        F.col("st") * F.col("st"), F.col("n") * F.col("sxx_n")))))
    return s


def revenue_trend_ols(orders: DataFrame, digits: int = 4) -> DataFrame:
    """Coefficient table of revenue ~ t: term, estimate, std_error, t_value (2 rows)."""
    s = _ols_moments(orders)
    rows = F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate"),
                 F.col("se_intercept").alias("std_error"),
                 F.try_divide(F.col("intercept"), F.col("se_intercept")).alias("t_value")),
        F.struct(F.lit("t").alias("term"), F.col("slope").alias("estimate"), F.col("se_slope").alias("std_error"),
                 F.try_divide(F.col("slope"), F.col("se_slope")).alias("t_value")))
    e = s.select(F.inline(rows))
    return e.select("term", *[round_half_up(c, digits).alias(c) for c in ("estimate", "std_error", "t_value")])


def revenue_trend_fit(orders: DataFrame, digits: int = 4) -> DataFrame:
    """R-squared and the monthly trend (slope) of revenue ~ t."""
    s = _ols_moments(orders)
    return s.select(as_long("n").alias("n_months"), round_half_up("r_squared", 6).alias("r_squared"),
                    round_half_up("slope", digits).alias("monthly_trend"))


def two_sided_t_pvalue(t, df) -> "F.Column":
    """P(|T| > |t|) for integer degrees of freedom, NULL where there are none.

    With theta = atan(|t| / sqrt(df)) the Student-t probability of [-|t|, |t|] is
    a finite sum of powers of cos(theta): for even df sin(theta) times the sum over
    k < df / 2 of (1*3*..*(2k-1)) / (2*4*..*2k) cos(theta)**2k, for odd df
    (2 / pi) (theta + sin(theta) cos(theta) times the sum over k < (df - 1) / 2 of
    (2*4*..*2k) / (3*5*..*(2k+1)) cos(theta)**2k).
    """
    t, df = F.abs(t), df.cast("int")
    theta = F.atan(t / F.sqrt(df.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc, k):
        nxt = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc["term"] * nxt * c2).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    ks = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(F.transform(ks, lambda k: k.cast("double")), start, step)["total"]
    inside = F.when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * total)).otherwise(F.sin(theta) * total)
    return F.when(t.isNotNull() & (df > 0), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))


def revenue_trend_pvalues(orders: DataFrame, digits: int = 4) -> DataFrame:
    """Full coefficient table of revenue ~ t: estimate, standard error, t and two-sided p-value (8 places).

    NULL errors and p-values where two months or fewer leave no degrees of freedom.
    """
    s = _ols_moments(orders)
    rows = F.array(*[
        F.struct(F.lit(term).alias("term"), F.col(est).alias("estimate"), F.col(se).alias("std_error"),
                 F.try_divide(F.col(est), F.col(se)).alias("t_value"), (F.col("n") - 2).alias("df"))
        for term, est, se in (("(Intercept)", "intercept", "se_intercept"), ("t", "slope", "se_slope"))])
    # the p-value in a step of its own: beside an alias of the same name, a column inside a
    # higher-order function would resolve to that alias
    e = s.select(F.inline(rows)).withColumn("p_value", two_sided_t_pvalue(F.col("t_value"), F.col("df")))
    return e.select("term", *[round_half_up(c, digits).alias(c) for c in ("estimate", "std_error", "t_value")],
                    round_half_up("p_value", 8).alias("p_value"))

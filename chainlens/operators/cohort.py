"""Customer cohort: activity per month, then lifetime summary and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions.classify import customer_tier
from chainlens.functions.numeric import as_double, as_long, mean, round_half_up
from chainlens.functions import constants as K
from chainlens.operators.revenue import order_count


def _months(orders: DataFrame, customer: str, status) -> DataFrame:
    """Per customer and month number (year x 12 + month - 1): an integer key keeps every step a hash aggregate."""
    src = orders if status is None else orders.where(F.col("status") == status)
    number = F.year("order_date") * 12 + F.month("order_date") - 1
    return (src.groupBy(customer, number.alias("_month"))
            .agg(order_count(orders).alias("orders_in_month"), F.sum("revenue").alias("revenue_in_month")))


def _month_text(c):
    return F.format_string("%04d-%02d", F.floor(F.col(c) / 12).cast("int"), (F.col(c) % 12 + 1).cast("int"))


def _month_or_null(c):
    return F.when(F.col(c).isNotNull(), _month_text(c))


def customer_months(orders: DataFrame, customer: str = "customer", status=K.DELIVERED) -> DataFrame:
    """customer, order_month, orders_in_month, revenue_in_month (``status=None`` keeps all statuses)."""
    return _months(orders, customer, status).select(
        customer, _month_or_null("_month").alias("order_month"), "orders_in_month", "revenue_in_month")


def customer_cohort(orders: DataFrame, customer: str = "customer", status=K.DELIVERED) -> DataFrame:
    """Lifetime summary per customer with tier, by lifetime value descending.

    Two aggregations: the first is partially combined map-side on
    (customer, month); the second runs over customer-month rows only, where a
    count of the months is a count of distinct months.
    """
    cm = _months(orders, customer, status)
    s = (cm.groupBy(customer)
         .agg(F.count("_month").alias("active_months"), F.sum("orders_in_month").alias("total_orders"),
              round_half_up(F.sum("revenue_in_month"), 2).alias("lifetime_value"),
              round_half_up(mean("revenue_in_month"), 2).alias("avg_monthly_revenue"),
              F.min("_month").alias("_first"), F.max("_month").alias("_last")))
    return (s.select(customer, as_long("active_months").alias("active_months"),
                     as_long("total_orders").alias("total_orders"), "lifetime_value", "avg_monthly_revenue",
                     _month_or_null("_first").alias("first_order_month"),
                     _month_or_null("_last").alias("last_order_month"),
                     customer_tier("active_months").alias("customer_tier"))
            .orderBy(F.col("lifetime_value").desc_nulls_last(), F.col(customer)))


def customer_months_out(orders: DataFrame, customer: str = "customer") -> DataFrame:
    cm = customer_months(orders, customer)
    return cm.select(customer, "order_month", as_long("orders_in_month").alias("orders_in_month"),
                     as_double("revenue_in_month").alias("revenue_in_month"))

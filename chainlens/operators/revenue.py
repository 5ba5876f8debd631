"""Revenue analyses: customer ranking and shares, monthly trend, top products,
daily series and top-k customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from chainlens.functions import constants as K
from chainlens.functions.dates import month_key
from chainlens.functions.numeric import as_double, as_long, col_, mean, pct, ratio, round_half_up
from chainlens.functions.windows import running_sum, whole_row


def delivered(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == K.DELIVERED)


def order_count(orders: DataFrame) -> Column:
    """COUNT(order_id) over order rows; over per-order totals (``line_count`` present)
    the same number is the sum of the line counts."""
    return F.sum("line_count") if "line_count" in orders.columns else F.count("order_id")


def with_order_weights(orders: DataFrame) -> DataFrame:
    """Give row-level orders the weight columns of per-order totals (a row counts as
    one order line if it has an id, its revenue if present, its lead days if dated),
    so code written for pre-aggregated rows runs on them unchanged."""
    if "line_count" in orders.columns:
        return orders
    lead = F.datediff("delivery_date", "order_date")
    return orders.select("*", F.col("order_id").isNotNull().cast("long").alias("line_count"),
                         F.col("revenue").isNotNull().cast("long").alias("revenue_count"),
                         lead.cast("long").alias("lead_day_sum"), lead.isNotNull().cast("long").alias("lead_day_count"))


def lead_mean(orders: DataFrame) -> Column:
    """AVG(delivery_date - order_date) in days, also over per-order totals (lead-day sums)."""
    if "lead_day_sum" in orders.columns:
        return ratio(F.sum("lead_day_sum"), F.sum("lead_day_count"))
    return F.avg(F.datediff("delivery_date", "order_date"))


def revenue_mean(orders: DataFrame) -> Column:
    """AVG(revenue) as exact sum / count, also over per-order totals (``revenue_count``)."""
    if "revenue_count" in orders.columns:
        return ratio(F.sum("revenue"), F.sum("revenue_count"))
    return mean("revenue")


def revenue_by_customer(orders: DataFrame, customer: str = "customer") -> DataFrame:
    """Delivered revenue per customer with share of total and running total.

    Output: customer, total_orders, total_revenue (unrounded), avg_order_value,
    revenue_share_pct, running_total — by total_revenue descending.
    The running total is a distributed prefix sum over the per-customer rows,
    whose bucket totals also give the grand total, so neither funnels the
    customers through one task and the orders are read once.
    """
    agg = (delivered(orders).groupBy(customer)
           .agg(order_count(orders).alias("total_orders"), F.sum("revenue").alias("_rev"),
                revenue_mean(orders).alias("_avg")))
    ranked = running_sum(agg, "_rev", "_rev", "_run", descending=True, ties=[customer], total="_grand")
    return (ranked.select(
        customer, as_long("total_orders").alias("total_orders"), as_double("_rev").alias("total_revenue"),
        round_half_up("_avg", 2).alias("avg_order_value"),
        round_half_up(pct("_rev", "_grand"), 2).alias("revenue_share_pct"),
        round_half_up("_run", 2).alias("running_total"))
        .orderBy(F.col("total_revenue").desc_nulls_last(), F.col(customer)))


def revenue_share_by_customer(orders: DataFrame, customer: str = "customer") -> DataFrame:
    """Script variant: rounded total, average and share of the grand total.

    The grand total is one row, summed from the per-customer rows (the same
    aggregation, whose shuffle is reused) and put beside each of them.
    """
    agg = (delivered(orders).groupBy(customer)
           .agg(order_count(orders).alias("_n"), F.sum("revenue").alias("_rev"), revenue_mean(orders).alias("_avg")))
    # (the same columns on both sides, so that the orders are read and shuffled once)
    grand = agg.agg(F.sum("_rev").alias("_sum"), F.max(whole_row(agg)).alias("_seen")).select(
        F.when(F.col("_seen").isNotNull(), F.col("_sum")).alias("_grand"))
    return (agg.crossJoin(F.broadcast(grand))  # one row
            .select(customer, as_long("_n").alias("total_orders"), round_half_up("_rev", 2).alias("total_revenue"),
                    round_half_up("_avg", 2).alias("avg_order_value"),
                    round_half_up(pct("_rev", "_grand"), 2).alias("revenue_share_pct"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), F.col(customer)))


def monthly_revenue_mom(orders: DataFrame) -> DataFrame:
    """Month, rounded revenue, previous present month's (unrounded) revenue and MoM growth %.

    The LAG window runs over one row per calendar month — bounded by the date
    range, not by the data volume.
    """
    m = delivered(orders).groupBy(month_key("order_date").alias("month")).agg(F.sum("revenue").alias("_rev"))
    prev = F.lag("_rev").over(Window.orderBy("month"))
    return (m.select("month", round_half_up("_rev", 2).alias("revenue"), as_double(prev).alias("prev_month_revenue"),
                     round_half_up(ratio(F.col("_rev") - prev, prev) * 100, 2).alias("mom_growth_pct"))
            .orderBy("month"))


def monthly_revenue_orders(orders: DataFrame) -> DataFrame:
    """Script variant: rounded revenue and order count per month; growth on the rounded revenue."""
    m = (delivered(orders).groupBy(month_key("order_date").alias("month"))
         .agg(round_half_up(F.sum("revenue"), 2).alias("revenue"), as_long(order_count(orders)).alias("orders")))
    prev = F.lag("revenue").over(Window.orderBy("month"))
    return (m.select("month", "revenue", "orders",
                     round_half_up(ratio(F.col("revenue") - prev, prev) * 100, 2).alias("mom_growth_pct"))
            .orderBy("month"))


def top_products_per_customer(orders: DataFrame, k: int = K.TOP_PRODUCTS_PER_CUSTOMER,
                              customer: str = "customer") -> DataFrame:
    """Products ranked by revenue within each customer, RANK <= k (ties kept)."""
    g = delivered(orders).groupBy(customer, "product").agg(F.sum("revenue").alias("_rev"))
    rank = F.rank().over(Window.partitionBy(customer).orderBy(F.col("_rev").desc_nulls_last()))
    return (g.select(customer, "product", as_double("_rev").alias("product_revenue"),
                     as_long(rank).alias("product_rank_within_customer"))
            .where(F.col("product_rank_within_customer") <= k)
            .orderBy(customer, "product_rank_within_customer", "product"))


def customer_revenue(orders: DataFrame, customer: str = "customer") -> DataFrame:
    """Delivered revenue per customer (customer, revenue); NULL customers dropped like a pandas groupby."""
    return (delivered(orders).where(F.col(customer).isNotNull())
            .groupBy(customer).agg(F.sum("revenue").alias("revenue")))


def top_customers(orders: DataFrame, k: int = K.TOP_K_CUSTOMERS, customer: str = "customer") -> DataFrame:
    """Top-k customers by revenue with display rank 1..k.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its k best rows, so only k x tasks rows ever meet.
    """
    top = (customer_revenue(orders, customer)
           .orderBy(F.col("revenue").desc_nulls_last(), F.col(customer)).limit(k))
    rank = F.row_number().over(Window.orderBy(F.col("revenue").desc_nulls_last(), F.col(customer)))
    return top.select(customer, as_double("revenue").alias("revenue"), as_long(rank).alias("rank"))


def daily_revenue(orders: DataFrame) -> DataFrame:
    """Delivered revenue per order date (date, revenue), ascending."""
    return (delivered(orders).where(F.col("order_date").isNotNull())
            .groupBy(F.col("order_date").alias("date")).agg(F.sum("revenue").alias("revenue"))
            .orderBy("date"))


def net_revenue(quantity, unit_price, discount) -> Column:
    """round(quantity x unit price x (1 - discount), 2) on exact decimals (declared
    DECIMAL(10,2) price, DECIMAL(5,3) discount; the product stays well inside 38 digits,
    so no intermediate rounding happens before the final one)."""
    q = col_(quantity).cast(DecimalType(12, 2))
    p = col_(unit_price).cast(DecimalType(12, 2))
    d = col_(discount).cast(DecimalType(5, 3))
    return F.round(q * p * (F.lit(1) - d), 2).cast(DecimalType(18, 2))

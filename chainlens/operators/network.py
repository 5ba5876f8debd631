"""Supplier -> customer dependency network.

The graph is kept as an edge DataFrame (supplier_id, customer, total_revenue):
node, edge and degree counts are group counts over it.  An adjacency is its edge
rows (with the supplier's degree), never a list per supplier: a list would hold
all customers of a supplier in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.numeric import as_long, ratio, round_half_up
from chainlens.operators.revenue import delivered


def supplier_edges(orders: DataFrame, customer: str = "customer") -> DataFrame:
    """One edge per (supplier, customer) pair with delivered revenue, rounded to 2 places."""
    d = delivered(orders).where(F.col("supplier_id").isNotNull() & F.col(customer).isNotNull())
    return (d.groupBy("supplier_id", F.col(customer).alias("customer"))
            .agg(round_half_up(F.sum("revenue"), 2).alias("total_revenue")))


def supplier_adjacency(edges: DataFrame) -> DataFrame:
    """One row per (supplier, customer) with the supplier's number of customers, ordered."""
    degrees = edges.groupBy("supplier_id").agg(as_long(F.count(F.lit(1))).alias("n_customers"))
    return (edges.select("supplier_id", F.col("customer").cast("string").alias("customer"))
            .join(degrees, "supplier_id").select("supplier_id", "n_customers", "customer")
            .orderBy("supplier_id", "customer"))


def network_stats(orders: DataFrame, customer: str = "customer") -> DataFrame:
    """nodes = suppliers + customers of delivered orders (also customers whose orders name no
    supplier), edges = distinct pairs, mean customers per supplier.

    Lines are grouped to (supplier, customer) pairs once, NULLs included; suppliers
    and customers are then grouped from the pairs and counted (one row each), so
    no row is expanded for a distinct count.
    """
    pairs = delivered(orders).groupBy("supplier_id", F.col(customer).alias("_customer")).agg(F.lit(1).alias("_one"))
    per_supplier = pairs.groupBy("supplier_id").agg(F.count("_customer").alias("_degree"))
    # a supplier counts if it has a pair, as in the edges
    known = F.col("supplier_id").isNotNull() & (F.col("_degree") > 0)
    s = per_supplier.agg(F.count_if(known).alias("_s"),
                         F.coalesce(F.sum(F.when(known, F.col("_degree"))), F.lit(0)).alias("_e"))
    # both branches read both columns of a pair, so that they share its shuffle and the lines are read once
    c = (pairs.groupBy("_customer").agg(F.max(F.xxhash64("supplier_id", "_customer")).alias("_seen"))
         .agg(F.count(F.when(F.col("_seen").isNotNull(), F.col("_customer"))).alias("_c")))
    return s.crossJoin(F.broadcast(c)).select(  # one row each
        as_long(F.col("_s") + F.col("_c")).alias("num_nodes"), as_long("_e").alias("num_edges"),
        as_long("_s").alias("num_suppliers"), as_long("_c").alias("num_customers"),
        round_half_up(ratio("_e", "_s"), 4).alias("avg_degree"))


def critical_suppliers(edges: DataFrame, min_customers: int = K.CRITICAL_SUPPLIER_MIN_CUSTOMERS,
                       with_customers: bool = True) -> DataFrame:
    """Suppliers serving at least ``min_customers`` customers (the degree is a plain group count),
    with one row per customer or, without them, one per supplier."""
    degrees = (edges.groupBy("supplier_id").agg(as_long(F.count(F.lit(1))).alias("n_customers"))
               .where(F.col("n_customers") >= min_customers))
    if not with_customers:
        return degrees.orderBy("supplier_id")
    return (edges.select("supplier_id", F.col("customer").cast("string").alias("customer"))
            .join(degrees, "supplier_id").select("supplier_id", "n_customers", "customer")
            .orderBy("supplier_id", "customer"))


def supplier_dependency(edges: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Edges with the supplier tier ('Unknown' when the supplier key has no match)."""
    s = suppliers.select(F.col("supplier_id").alias("_sid"), "tier")
    j = edges.join(s, F.col("supplier_id") == F.col("_sid"), "left")
    return (j.select("supplier_id", "customer", "total_revenue",
                     F.when(F.col("_sid").isNull(), F.lit(K.UNKNOWN_TIER)).otherwise(F.col("tier")).alias("tier"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), "supplier_id", "customer"))

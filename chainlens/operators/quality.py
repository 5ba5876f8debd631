"""Quality-inspection analyses: defect rates by product/plant, per-product
statistics and the row-level defect rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions import constants as K
from chainlens.functions.classify import below_rag
from chainlens.functions.numeric import as_double, as_long, pct, ratio, round_half_up
from chainlens.functions.windows import exact_quantiles


def with_inspection_weights(insp: DataFrame) -> DataFrame:
    """Give inspection rows the sum columns of pre-aggregated ones (``inspection_count``, ``failed``,
    ``defect_rate_sum``, ``defect_rate_count``), so one code path reads both."""
    if "inspection_count" in insp.columns:
        return insp
    has = F.col("inspection_id").isNotNull().cast("long") if "inspection_id" in insp.columns else F.lit(1).cast("long")
    failed = F.when(F.col("passed") == 0, 1).otherwise(0) if "passed" in insp.columns else F.lit(None).cast("int")
    return (insp.withColumn("inspection_count", has).withColumn("failed", failed)
            .withColumn("defect_rate_sum", F.col("defect_rate"))
            .withColumn("defect_rate_count", F.col("defect_rate").isNotNull().cast("long")))


def _by_product_plant(insp: DataFrame) -> DataFrame:
    return (with_inspection_weights(insp).groupBy("product", "plant")
            .agg(F.sum("inspection_count").alias("_n"), F.sum("defects_found").alias("_def"),
                 F.sum("batch_size").alias("_units"), F.sum("failed").alias("_failed")))


def defects_by_product_plant(insp: DataFrame, green_below: float = K.QUALITY_GREEN_BELOW,
                             amber_below: float = K.QUALITY_AMBER_BELOW) -> DataFrame:
    """Per product and plant: counts, defect % (ratio of sums), failures, and the
    quality RAG on the *unrounded* defect % (NULL -> RED)."""
    rate = pct("_def", "_units")
    return (_by_product_plant(insp).select(
        "product", "plant", as_long("_n").alias("total_inspections"),
        as_double("_def").alias("total_defects"), as_long("_units").alias("total_units"),
        round_half_up(rate, 3).alias("defect_rate_pct"), as_long("_failed").alias("failed_inspections"),
        round_half_up(pct("_failed", "_n"), 2).alias("failure_rate_pct"),
        below_rag(rate, green_below, amber_below).alias("quality_rag"))
        .orderBy(F.col("defect_rate_pct").desc_nulls_last(), "product", "plant"))


def defects_by_product_plant_rounded(insp: DataFrame, green_below: float = K.QUALITY_GREEN_BELOW,
                                     amber_below: float = K.QUALITY_AMBER_BELOW) -> DataFrame:
    """Script variant: float ratio, no failed count, RAG on the defect % rounded to 3 places."""
    rate = round_half_up(ratio(as_double("_def"), "_units") * 100, 3)
    out = _by_product_plant(insp).select(
        "product", "plant", as_long("_n").alias("inspections"), as_double("_def").alias("total_defects"),
        as_long("_units").alias("total_units"), rate.alias("defect_rate_pct"),
        round_half_up(ratio(as_double("_failed"), "_n") * 100, 2).alias("failure_rate_pct"))
    return (out.withColumn("quality_rag", below_rag("defect_rate_pct", green_below, amber_below))
            .orderBy(F.col("defect_rate_pct").desc_nulls_last(), "product", "plant"))


#: the rate's declared scale (DECIMAL(6,4)): moments are taken over rate x 10**4, an integer
_RATE_UNIT = 10_000


def defect_stats_by_product(insp: DataFrame, digits: int | None = None) -> DataFrame:
    """Per product: mean, exact median and sample sd of the row defect rate, totals and
    the overall rate (ratio of sums); by mean descending.

    The inspections (or their totals per rate) are combined to a (product, defect
    rate) -> count table that also carries the defect and unit sums (bounded by
    products x the DECIMAL(6,4) domain); the median comes from its distributed
    cumulative counts, and in the same pass mean and sd from moment sums over the rate in integer
    units of 10**-4, so no product of sums is cut to a decimal's scale.  A product whose
    inspections are all NULL keeps its row.
    """
    weighted = with_inspection_weights(insp)
    c, v = F.col("_cl_c").cast("decimal(18,0)"), F.round(F.col("_cl_v") * _RATE_UNIT).cast("decimal(10,0)")
    n, s1, s2 = F.col("_n"), F.col("_s1"), F.col("_s2")
    sums = exact_quantiles(
        weighted, "defect_rate", [0.5], ["median_defect_rate"], by=["product"], weight="defect_rate_count",
        carry=["defects_found", "batch_size"], extra=[
            F.sum("_cl_c").alias("_n"), F.sum((v * c).cast("decimal(28,0)")).cast("decimal(18,0)").alias("_s1"),
            F.sum((v * v * c).cast("decimal(38,0)")).cast("decimal(19,0)").alias("_s2"),
            F.sum("defects_found").alias("total_defects"), F.sum("batch_size").alias("total_units")])
    # sample variance = (n*S2 - S1^2) / (n*(n-1)); the numerator is an exact integer
    var = F.try_divide((n.cast("decimal(18,0)") * s2 - s1 * s1).cast("double"),
                       n.cast("double") * (n - F.lit(1)).cast("double"))
    j = sums.select("product", "median_defect_rate", (ratio(s1, n) / _RATE_UNIT).alias("mean_defect_rate"),
                    (F.sqrt(var) / _RATE_UNIT).alias("sd_defect_rate"), "total_defects", "total_units")
    r = (lambda c: round_half_up(c, digits)) if digits is not None else as_double
    return (j.select("product", r("mean_defect_rate").alias("mean_defect_rate"),
                     r("median_defect_rate").alias("median_defect_rate"), r("sd_defect_rate").alias("sd_defect_rate"),
                     r("total_defects").alias("total_defects"), as_long("total_units").alias("total_units"),
                     r(ratio("total_defects", "total_units")).alias("overall_rate"))
            .orderBy(F.col("mean_defect_rate").desc_nulls_last(), "product"))


def defect_pct_by_product(insp: DataFrame) -> DataFrame:
    """product, defect_pct = 100 x sum(defects) / sum(units) (unrounded), ascending."""
    g = insp.groupBy("product").agg(F.sum("defects_found").alias("_d"), F.sum("batch_size").alias("_u"))
    return g.select("product", pct("_d", "_u").alias("defect_pct")).orderBy("defect_pct", "product")


def defect_rate_mean(insp: DataFrame):
    """AVG(defect_rate) over inspections, also over pre-aggregated rows
    (``defect_rate_sum`` / ``defect_rate_count``)."""
    if "defect_rate_sum" in insp.columns:
        return ratio(F.sum("defect_rate_sum"), F.sum("defect_rate_count"))
    return ratio(F.sum("defect_rate"), F.count("defect_rate"))


def row_defect_rate(insp: DataFrame) -> DataFrame:
    """defect_rate = round(defects_found / batch_size, 4) per inspection row."""
    return insp.select("order_id", "inspection_id", as_long("batch_size").alias("batch_size"),
                       as_double("defects_found").alias("defects_found"),
                       round_half_up(ratio("defects_found", "batch_size"), 4).alias("defect_rate"))

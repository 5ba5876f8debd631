"""Mergeable quantile sketches: facts are read once per period, roll-ups read only sketches.

:func:`value_sketches` keeps a KLL sketch per group (a few KB whatever the number of rows) beside exact
counts, sums and extremes; the table can be stored, and new periods appended.  :func:`roll_up` merges stored sketches
to any coarser grouping, and :func:`sketch_quantiles` reads quantiles.  A quantile's rank is off by
about 1.7 / k**0.9 (0.5 % for the default k), whatever the number of merges; exact ones come
from :func:`~chainlens.functions.windows.exact_quantiles`, which reads the facts again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.functions.numeric import col_

DEFAULT_K = 800


def value_sketches(df: DataFrame, by: Sequence, value, k: int = DEFAULT_K) -> DataFrame:
    """Per group of ``by`` (columns or names): ``n`` (values, NULLs left out), ``total``, ``smallest``, ``largest``, ``sketch``.

    A group without values keeps its row, with a NULL sketch.
    """
    v = col_(value)
    return (df.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("smallest"), F.max(v).alias("largest"),
        F.kll_sketch_agg_double(v.cast("double"), F.lit(k)).alias("sketch"))
        .withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch"))))


def roll_up(sketches: DataFrame, by: Sequence, k: int = DEFAULT_K) -> DataFrame:
    """Sketch rows merged to the coarser groups of ``by``; no facts are read."""
    return (sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
        .withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch"))))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The sketches' columns with a quantile column per probability in place of ``sketch`` (NULL without values)."""
    def quantile(p: float) -> Column:
        if p <= 0 or p >= 1:  # the extremes are kept exactly
            return F.col("smallest" if p <= 0 else "largest").cast("double")
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))

    return sketches.select("*", *[quantile(p).alias(n) for p, n in zip(probs, names)]).drop("sketch")


def rank_errors(facts: DataFrame, quantiles: DataFrame, by: Sequence[str], value, probs: Sequence[float],
                names: Sequence[str]) -> DataFrame:
    """Audit: per group, how far the true rank of each quantile column lies from its probability.

    The facts are read once: each row counts towards the quantiles of its group that it is below or equal to.
    A value's rank is an interval where several rows share it; inside it the error is 0.
    """
    v = col_(value).cast("double")
    q = quantiles.select(*[F.col(b).alias(f"_g_{b}") for b in by], *names)
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    rows = facts.select(*by, v.alias("_v")).where(F.col("_v").isNotNull()).join(q, cond)
    n = F.count(F.lit(1))
    aggs = []
    for p, name in zip(probs, names):
        below, upto = F.count_if(F.col("_v") < F.col(name)) / n, F.count_if(F.col("_v") <= F.col(name)) / n
        aggs.append(F.greatest(below - p, p - upto, F.lit(0.0)).alias(name))
    return rows.groupBy(*by).agg(n.alias("n"), *aggs)

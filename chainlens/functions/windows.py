"""Order-dependent aggregates that stay distributed and lazy.

An un-partitioned window (``OVER (ORDER BY ...)``) moves every row into one
task.  That is fine for calendar series (one row per day or month: the row
count is bounded by the date range), but not for a running total over
customers or a cumulative count over distinct values, whose row count grows
with the data.  :func:`running_sum` is the two-phase prefix sum used instead:

1. every row gets a *bucket*, a non-decreasing function of its sort value alone
   (256 buckets per factor of two), so bucket order is sort order;
2. per bucket, a window running sum;
3. per-bucket totals -> exclusive prefix over the buckets -> offsets (bounded
   by the number of buckets, about 2**19 for all finite doubles);
4. the offsets are joined back on the bucket and added.

The bucket depends on the row only, not on a sampled range partitioning, so the
two branches need no common materialisation: the plan is lazy, recomputable
after the loss of an executor, and its result does not depend on how many
partitions a shuffle has.

Equal sort values (zero, NULL, any popular value) share a bucket whatever its
width.  Where the order has tie columns, every value that more than
``HOT_ROWS`` rows hold is cut into slices by the first tie column (evenly between
the smallest and the largest tie of that value), and the bucket's other rows lie before or after them:
a bucket is then (bucket, place among the bucket's hot values, slice).

:func:`exact_quantiles` builds on it: value -> count (map-side combined),
cumulative counts, then the two order statistics around each requested
probability, interpolated linearly (``quantile_cont`` / R type 7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from chainlens.functions.numeric import col_

_BUCKET = "_cl_bucket"
_PER_OCTAVE = 256
_ZERO = 1100 * _PER_OCTAVE  # beyond the buckets of the smallest positive double
_NULLS_LAST = 1 << 30
_PLACE, _SLICE = "_cl_place", "_cl_slice"
#: a sort value that more rows hold is cut into slices of about so many rows
HOT_ROWS = 100_000
#: so many values are cut, the most frequent ones; this bounds the broadcast table of them
MOST_HOT = 1000
_MOST_SLICES = 1 << 16


def whole_row(df: DataFrame) -> Column:
    """A value of all columns, never NULL.

    A second branch over ``df`` that depends on it reads the same columns as the first one, so that
    both have one plan up to their last shuffle and Spark runs it once (exchange reuse).
    """
    return F.xxhash64(*[F.col(c) for c in df.columns])


def sort_bucket(value, descending: bool = False) -> Column:
    """Bucket of a numeric sort value: non-decreasing in sort order, NULL last."""
    v = col_(value).cast("double")
    level = lambda x: F.floor(F.log2(x) * _PER_OCTAVE).cast("int") + _ZERO + 1
    b = F.when(v > 0, level(v)).when(v < 0, -level(-v)).otherwise(F.lit(0))
    # never NULL, and known to be: a join on it then adds no IS NOT NULL filter below one of two branches,
    # which would keep them from sharing a shuffle
    return F.coalesce(F.when(v.isNull(), F.lit(_NULLS_LAST)).otherwise(-b if descending else b), F.lit(0))


def _code(tie: Column, numeric: bool, skip) -> Column:
    """A number that does not decrease in the order of ``tie``: the value itself, or the four bytes of a text
    behind the first ``skip`` hexadecimal digits, which all texts of the value share."""
    if numeric:
        return tie.cast("double")
    digits = F.rpad(F.substring(F.hex(tie.cast("string").cast("binary")), skip + 1, F.lit(8)), 8, "0")
    return F.conv(digits, 16, 10).cast("double")


def _shared_digits(lo: Column, hi: Column) -> Column:
    """Number of hexadecimal digits that two texts begin with in common."""
    a, b = F.hex(lo.cast("string").cast("binary")), F.hex(hi.cast("string").cast("binary"))
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n < 1, F.lit(0)).otherwise(F.coalesce(F.array_min(differ) - 1, n))


def _sliced(rows: DataFrame, seen: Column, value: Column, descending: bool, tie: str, by: Sequence[str],
            hot_rows: int) -> DataFrame:
    """``rows`` with their place among the bucket's hot values and their slice inside such a value."""
    numeric = isinstance(rows.schema[tie].dataType, NumericType)
    tally = (rows.groupBy(*by, _BUCKET, value.alias("_cl_value"))
             .agg(F.count(F.lit(1)).alias("_cl_n"), F.min(tie).alias("_cl_lo"), F.max(tie).alias("_cl_hi"),
                  F.max(seen).alias("_cl_seen")))
    skip = F.lit(0) if numeric else _shared_digits(F.col("_cl_lo"), F.col("_cl_hi"))
    hot = (tally.where((F.col("_cl_n") > hot_rows) & F.col("_cl_seen").isNotNull())
           .orderBy(F.col("_cl_n").desc(), *by, "_cl_value").limit(MOST_HOT).withColumn("_cl_skip", skip.cast("int")))
    code = lambda c: _code(F.col(c), numeric, F.col("_cl_skip"))
    entry = F.struct(F.col("_cl_value").alias("value"), F.col("_cl_skip").alias("skip"), code("_cl_lo").alias("lo"),
                     code("_cl_hi").alias("hi"),
                     F.least(F.ceil(F.col("_cl_n") / hot_rows), F.lit(_MOST_SLICES)).cast("int").alias("slices"))
    hot = hot.groupBy(*[F.col(b).alias(f"_cl_h_{b}") for b in by], F.col(_BUCKET).alias("_cl_h_bucket")).agg(
        F.collect_list(entry).alias("_cl_hot"))
    cond = F.col(_BUCKET).eqNullSafe(F.col("_cl_h_bucket"))
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_cl_h_{b}"))
    met = rows.withColumn("_cl_value", value).join(F.broadcast(hot), cond, "left")  # at most MOST_HOT rows
    met = met.withColumn("_cl_mine", F.get(F.filter("_cl_hot", lambda h: h["value"].eqNullSafe(F.col("_cl_value"))), F.lit(0)))
    earlier = F.size(F.filter("_cl_hot", lambda h: h["value"] > F.col("_cl_value") if descending
                              else h["value"] < F.col("_cl_value")))
    mine = F.col("_cl_mine")
    share = (_code(F.col(tie), numeric, mine["skip"]) - mine["lo"]) / (mine["hi"] - mine["lo"] + 1)
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * mine["slices"]).cast("int")
    return (met.withColumn(_PLACE, F.coalesce(F.when(F.col("_cl_hot").isNotNull(), 2 * earlier + F.when(
                mine.isNotNull(), F.lit(1)).otherwise(F.lit(0))), F.lit(0)))
            .withColumn(_SLICE, F.coalesce(F.when(mine.isNotNull(), at), F.lit(0)))
            .drop("_cl_value", "_cl_hot", "_cl_mine", "_cl_h_bucket", *[f"_cl_h_{b}" for b in by]))


def running_sum(df: DataFrame, value, sort_by, out: str, descending: bool = False, ties: Sequence[str] = (),
                by: Sequence[str] = (), total: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` (ROWS UNBOUNDED PRECEDING) in the order of the numeric ``sort_by``.

    NULL sort values come last, ``ties`` (columns) make the order total, ``by``
    restarts it per group (NULL is a group).  As in SQL, NULL values add nothing
    and the sum is NULL until the first value.  ``total`` adds the group's sum.
    No window partition grows with the rows of one sort value (``hot_rows``, by default :data:`HOT_ROWS`) if there
    are ties.
    """
    v, by = col_(value), list(by)
    seen = whole_row(df)
    rows = df.withColumn(_BUCKET, sort_bucket(sort_by, descending))
    keys = [_BUCKET]
    if ties:
        rows = _sliced(rows, seen, col_(sort_by), descending, ties[0], by, hot_rows or HOT_ROWS)
        keys += [_PLACE, _SLICE]
    order = col_(sort_by).desc_nulls_last() if descending else col_(sort_by).asc_nulls_last()
    inside = Window.partitionBy(*by, *keys).orderBy(order, *[F.col(c).asc() for c in ties]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_cl_local", F.sum(v).over(inside))
    sums = rows.groupBy(*by, *keys).agg(F.sum(v).alias("_cl_sum"), F.max(seen).alias("_cl_seen")).select(
        *by, *keys, F.when(F.col("_cl_seen").isNotNull(), F.col("_cl_sum")).alias("_cl_ptot"))
    group = Window.partitionBy(*by)
    before = group.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(b).alias(f"_cl_o_{b}") for b in (*by, *keys)],
                          F.sum("_cl_ptot").over(before).alias("_cl_off"),
                          *([F.sum("_cl_ptot").over(group).alias(total)] if total else []))
    cond = F.lit(True)
    for b in keys:
        cond = cond & (F.col(b) == F.col(f"_cl_o_{b}"))
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_cl_o_{b}"))
    joined = local.join(offsets, cond)
    off = F.col("_cl_off")
    return (joined.withColumn(out, F.when(off.isNull(), F.col("_cl_local")).otherwise(
        off + F.coalesce(F.col("_cl_local"), F.lit(0))))
        .drop(*keys, "_cl_local", "_cl_off", *[f"_cl_o_{b}" for b in (*by, *keys)]))


def exact_quantiles(df: DataFrame, value, probs: Sequence[float], names: Sequence[str],
                    by: Sequence[str] = (), mean_name: str | None = None, weight: str | None = None,
                    carry: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Exact linearly-interpolated quantiles of ``value`` (NULLs ignored).

    Returns one row per ``by`` group (one row overall when ``by`` is empty)
    with a DOUBLE column per name.  Work is proportional to the number of
    distinct values; no task ever holds more than a few buckets of
    them, and nothing is collected to the driver.  With ``weight`` the input
    is already a value -> count table (``weight`` holds the counts).

    ``carry`` columns are summed per value (of the rows without a value, too, if
    there is a ``weight``), and ``extra`` are aggregates over those sums and the
    columns ``_cl_v`` (value) and ``_cl_c`` (count): statistics of the same rows
    that need no second pass.
    """
    by = list(by)
    # Group on the exact value (integer / decimal), interpolate in DOUBLE.
    tally = F.count(F.lit(1)) if weight is None else F.sum(F.when(F.col("_cl_v").isNotNull(), F.col(weight)).otherwise(0))
    cols = [*by, col_(value).alias("_cl_v")] + ([F.col(weight)] if weight else []) + list(carry)
    counts = (df.select(*cols).where(F.col("_cl_v").isNotNull() | F.lit(weight is not None))
              .groupBy(*by, "_cl_v").agg(tally.alias("_cl_c"), *[F.sum(c).alias(c) for c in carry]))
    # cumulative counts in value order inside every group; NULL is a group of its own (as in GROUP BY)
    ranked = running_sum(counts, "_cl_c", "_cl_v", "_cl_cum", by=by, total="_cl_n")
    # 0-based ranks covered by a distinct value: [cum - c, cum - 1].
    lo_rank = F.col("_cl_cum") - F.col("_cl_c")
    hi_rank = F.col("_cl_cum") - F.lit(1)
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_cl_n") - F.lit(1)).cast("double") * F.lit(float(p))
        fl, ce = F.floor(pos), F.ceil(pos)
        vd = F.col("_cl_v").cast("double")
        aggs.append(F.max(F.when((fl >= lo_rank) & (fl <= hi_rank), vd)).alias(f"_cl_lo{i}"))
        aggs.append(F.max(F.when((ce >= lo_rank) & (ce <= hi_rank), vd)).alias(f"_cl_hi{i}"))
        aggs.append(F.max(pos - fl).alias(f"_cl_fr{i}"))
    if mean_name:
        # Exact sum of value x count over the distinct values, divided in DOUBLE.
        aggs.append(F.try_divide(F.sum(F.col("_cl_v") * F.col("_cl_c")).cast("double"),
                                 F.sum("_cl_c").cast("double")).alias(mean_name))
    picked = ranked.groupBy(*by).agg(*aggs, *extra)
    done = {*by, mean_name, *(a for i in range(len(probs)) for a in (f"_cl_lo{i}", f"_cl_hi{i}", f"_cl_fr{i}"))}
    outs = [(F.col(f"_cl_lo{i}") + (F.col(f"_cl_hi{i}") - F.col(f"_cl_lo{i}")) * F.col(f"_cl_fr{i}")).alias(name)
            for i, name in enumerate(names)]
    return picked.select(*by, *outs, *([mean_name] if mean_name else []), *[c for c in picked.columns if c not in done])

"""Daily revenue totals kept up to date by signed changes, instead of being recomputed.

The state has one row per day: ``day``, ``line_count``, ``revenue``, ``revenue_count``, ``lead_day_sum``,
``lead_day_count``.  These are the sums that the monthly, daily and rolling analyses need (means are quotients of them), and all of
them can be taken back: a changed line is its old version with sign -1 and its new one with sign +1.  Merging is a union
and one aggregate, so the order of changes doesn't matter and an average or count never drifts.

Stored, the state is Parquet partitioned by ``month``; :func:`apply_changes` reads and rewrites only the months that the
changes touch.  Every month carries the number of the last batch merged into it, so a batch that
failed half way, or is sent twice, can be applied again: months that have it are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions import constants as K

SIGN = "sign"
SUMS = ("line_count", "revenue", "revenue_count", "lead_day_sum", "lead_day_count")


def signed(lines: DataFrame, sign: int) -> DataFrame:
    """``lines`` as insertions (+1) or retractions (-1)."""
    if sign not in (1, -1):
        raise ValueError("a change has sign 1 or -1")
    return lines.withColumn(SIGN, F.lit(sign))


def daily_changes(lines: DataFrame, status: str = K.DELIVERED) -> DataFrame:
    """Per day, the signed sums of the changed order lines (without ``sign``, all are insertions)."""
    src = lines if SIGN in lines.columns else signed(lines, 1)
    src = src.where(F.col("status") == status)
    lead = F.datediff("delivery_date", "order_date").cast("long")
    s = F.col(SIGN)
    parts = {"line_count": F.when(F.col("order_id").isNotNull(), s).otherwise(0), "revenue": F.col("revenue") * s,
             "revenue_count": F.when(F.col("revenue").isNotNull(), s).otherwise(0),
             "lead_day_sum": F.coalesce(lead * s, F.lit(0)),
             "lead_day_count": F.when(lead.isNotNull(), s).otherwise(0)}
    total = src.groupBy(F.col("order_date").alias("day")).agg(*[F.sum(x).alias(c) for c, x in parts.items()])
    return _typed(total)


def _typed(state: DataFrame) -> DataFrame:
    return state.select("day", *[F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,2)" if c == "revenue" else "long").alias(c)
                                 for c in SUMS])


def merge(state: DataFrame, *changes: DataFrame) -> DataFrame:
    """The state after the changes.  A day whose lines have all been taken back stays with zero sums (see :func:`days`)."""
    both = state.select("day", *SUMS)
    for c in changes:
        both = both.unionByName(c.select("day", *SUMS))
    return _typed(both.groupBy("day").agg(*[F.sum(c).alias(c) for c in SUMS]))


def days(state: DataFrame) -> DataFrame:
    """The days that have lines, as weighted order rows that the revenue operators read
    (``order_date``, ``status`` and the sums)."""
    return (state.where((F.col("line_count") != 0) | (F.col("revenue_count") != 0))
            .select(F.col("day").alias("order_date"), F.lit(K.DELIVERED).alias("status"),
                    F.when(F.col("revenue_count") != 0, F.col("revenue")).alias("revenue"),
                    "line_count", "revenue_count", "lead_day_sum", "lead_day_count"))


_MONTH, _BATCH = "month", "batch"
_NO_DAY = "none"  # partition of lines without an order date


def _month_of(day):
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(_NO_DAY))


def _write(rows: DataFrame, path: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_MONTH).parquet(path))


def create_state(lines: DataFrame, path: str, batch: int = 0) -> None:
    """Write the state of ``lines`` as a new table."""
    first = daily_changes(lines)
    _write(first.withColumn(_MONTH, _month_of("day")).withColumn(_BATCH, F.lit(batch).cast("long")), path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


_STORED = ("day date, line_count bigint, revenue decimal(38,2), revenue_count bigint, lead_day_sum bigint, "
           "lead_day_count bigint, batch bigint, month string")


def apply_changes(spark: SparkSession, path: str, lines: DataFrame, batch: int) -> list[str]:
    """Merge the signed ``lines`` of ``batch`` into the state at ``path``; returns the months rewritten.

    Batch numbers grow.  The months touched (a name each) are all that reaches the driver; the partitions of other
    months are neither read nor written.
    """
    change = daily_changes(lines).withColumn(_MONTH, _month_of("day"))
    months = sorted(r[0] for r in change.select(_MONTH).distinct().collect())
    if not months:
        return []
    state = read_state(spark, path).where(F.col(_MONTH).isin(months))
    done = {r[0] for r in state.groupBy(_MONTH).agg(F.max(_BATCH).alias("b")).where(F.col("b") >= batch).collect()}
    todo = [m for m in months if m not in done]
    if todo:
        old, new = state.where(F.col(_MONTH).isin(todo)), change.where(F.col(_MONTH).isin(todo))
        rows = merge(old, new).withColumn(_MONTH, _month_of("day")).withColumn(_BATCH, F.lit(batch).cast("long"))
        _write(rows, path)
    return todo

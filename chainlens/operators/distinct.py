"""Exact distinct counts that merge: a bitmap per group and bucket of integer keys.

``COUNT(DISTINCT key)`` per month cannot be added up to a year, and several of them in one query expand
every row.  Here a key sets one bit: key ranges of 32,768 are buckets, and a group's keys in a bucket are one
bitmap (4 KB), built before the shuffle in each task.  A coarser group's bitmaps are the OR of its parts', and a distinct
count is the number of bits.  The rows that move are bitmaps, at most one per task, group and touched bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

BUCKET, BITMAP = "key_bucket", "key_bitmap"


def key_bitmaps(df: DataFrame, by: Sequence, key: str) -> DataFrame:
    """``by``, ``key_bucket``, ``key_bitmap``: the distinct non-NULL values of the integer column ``key``.

    Groups whose keys are all NULL have no rows (their count is 0).
    """
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer column; give text keys a number first")
    k = F.col(key).cast("long")
    return (df.where(k.isNotNull()).groupBy(*by, F.bitmap_bucket_number(k).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias(BITMAP)))


def merge_bitmaps(bitmaps: DataFrame, by: Sequence) -> DataFrame:
    """The bitmaps of the coarser groups of ``by`` (columns or names)."""
    return bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def distinct_counts(bitmaps: DataFrame, by: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """``by`` and the number of distinct keys; without ``by``, one row."""
    return bitmaps.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count(BITMAP)), F.lit(0)).cast("long").alias(name))


def calendar_distinct(df: DataFrame, date: str, key: str, name: str) -> DataFrame:
    """Distinct keys per month, per year and overall: ``period`` (``yyyy-MM``, ``yyyy``, ``all``), ``name``.

    Rows are read once, for the months; a year is the OR of its months, the whole the OR of the years.
    """
    months = key_bitmaps(df.where(F.col(date).isNotNull()), [F.date_format(date, "yyyy-MM").alias("period")], key)
    years = merge_bitmaps(months, [F.substring("period", 1, 4).alias("period")])
    whole = merge_bitmaps(years, [F.lit("all").alias("period")])
    return (distinct_counts(months, ["period"], name).unionByName(distinct_counts(years, ["period"], name))
            .unionByName(distinct_counts(whole, ["period"], name)))


def distinct_columns(df: DataFrame, by: Sequence[str], keys: dict[str, str]) -> DataFrame:
    """Several distinct counts per group in one pass without expanding rows per count: ``by`` and ``name`` for each
    ``{name: integer column}``.

    A row carries its keys as an array of (count, key) pairs into the same bitmap aggregate; what is shuffled are bitmaps.
    """
    for c in keys.values():
        if not isinstance(df.schema[c].dataType, IntegralType):
            raise TypeError(f"{c} must be an integer column; give text keys a number first")
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("long").alias("key")) for name, c in keys.items()])
    flat = df.select(*by, F.explode(pairs).alias("p")).select(*by, F.col("p.name").alias("_name"), F.col("p.key").alias("_key"))
    maps = (flat.groupBy(*by, "_name", F.bitmap_bucket_number(F.col("_key")).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_key"))).alias(BITMAP)))
    size = F.when(F.col(BUCKET).isNotNull(), F.bitmap_count(BITMAP)).otherwise(0)
    return maps.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("_name") == n, size)), F.lit(0)).cast("long").alias(n)
                                   for n in keys])

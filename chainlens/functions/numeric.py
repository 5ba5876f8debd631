"""Numeric helpers: exact HALF_UP rounding, guarded ratios, output typing.

Rounding (decision D1): ``round`` on a DOUBLE rounds the shortest decimal
representation in Spark but the binary value in most other engines, so
0.285 becomes 0.29 in one and 0.28 in the other.  Every rounded output is
therefore computed as ``round(cast(x as decimal(38,10)), n)`` — HALF_UP on an
exact decimal — and only then cast to DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NumericType

EXACT = DecimalType(38, 10)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """HALF_UP rounding to ``digits`` places on an exact decimal, returned as DOUBLE."""
    return F.round(col_(c).cast(EXACT), digits).cast("double")


def as_double(c) -> Column:
    return col_(c).cast("double")


def as_long(c) -> Column:
    return col_(c).cast("long")


def ratio(num, den) -> Column:
    """``num / den`` in DOUBLE, NULL instead of an error on a zero divisor (D5).

    Both operands are converted once from their exact (integer / decimal)
    values.  A DECIMAL quotient would be cheaper to read but Spark caps its
    scale at 6 places when the operands are wide (sums are), which rounds
    once at 6 places and again at the final rounding — 9.55049999 would
    become 9.551 instead of 9.550.
    """
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def pct(num, den) -> Column:
    """``num * 100 / den``: the scaling is exact (integer/decimal), the quotient DOUBLE."""
    return ratio(col_(num) * F.lit(100), den)


def mean(c) -> Column:
    """Average as exact sum / count in DOUBLE (no intermediate 6-place decimal rounding)."""
    return ratio(F.sum(col_(c)), F.count(col_(c)))


def round_numeric_columns(df: DataFrame, digits: int) -> DataFrame:
    """Round every non-integral numeric column of ``df`` (HALF_UP), keeping others as they are."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, IntegralType):
            out.append(round_half_up(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)

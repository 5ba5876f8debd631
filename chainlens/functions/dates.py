"""Date helpers (dialect rewrites of the reference's date functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainlens.functions.numeric import col_


def month_key(c) -> Column:
    """``yyyy-MM`` text month (MySQL ``DATE_FORMAT(d,'%Y-%m')`` / ``SUBSTR(d,1,7)``)."""
    return F.date_format(col_(c), "yyyy-MM")


def month_start(c) -> Column:
    """First day of the month as DATE (R ``floor_date(d, 'month')``)."""
    return F.trunc(col_(c), "MM")


def month_label(c) -> Column:
    """Short chart label such as ``Jan-23``."""
    return F.date_format(col_(c), "MMM-yy")


def lead_days(delivery, order) -> Column:
    """Whole days between order and delivery (signed), as BIGINT."""
    return F.datediff(col_(delivery), col_(order)).cast("long")


def epoch_day(c) -> Column:
    """Days since 1970-01-01 — a numeric key for RANGE frames over dates."""
    return F.unix_date(F.to_date(col_(c)))

"""Calendar expressions with the reference's meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: output patterns
YEAR_MONTH_PATTERN = "yyyy-MM"  # e.g. 2017-11
WEEKDAY_PATTERN = "EEEE"  # full English weekday name, e.g. Friday


def year_month(ts: Column) -> Column:
    return F.date_format(ts, YEAR_MONTH_PATTERN)


def weekday_name(ts: Column) -> Column:
    """Full English day name (``dayname`` would give the short form)."""
    return F.date_format(ts, WEEKDAY_PATTERN)


def day_gap(start: Column, end: Column) -> Column:
    """Number of midnights from ``start`` to ``end`` (day-boundary difference)."""
    return F.datediff(end, start).cast("bigint")


def calendar_year(ts: Column) -> Column:
    return F.year(ts).cast("bigint")


def calendar_month(ts: Column) -> Column:
    return F.month(ts).cast("bigint")

"""Money and ratio expressions.

Money is ``decimal(18,2)``, so sums are exact. Everything that is rounded after a
division (means, percentages) is rounded half up on exact integers:

    round_half_up(n / k) == (2n + k) div (2k)        for n >= 0, k > 0

with ``n`` a number of cents (or ``10000 * a`` for a percentage ``100 * a / b`` with
two decimals). The oracle SQL uses the same integer form, so both engines agree to
the last bit; a double mean would not (``round(1.005, 2)`` differs between them).
Results stay decimal: a ``double`` has no cents left above 2**53 of them. Whoever
needs doubles casts a whole result with :func:`as_doubles`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = "decimal(38,0)"


def line_revenue(with_freight: bool = True) -> Column:
    """Revenue of one order line: ``price + freight_value`` or ``price`` alone."""
    price = F.col("price")
    return price + F.col("freight_value") if with_freight else price


def as_money(c: Column) -> Column:
    """An exact decimal sum rounded to cents."""
    return F.round(c, 2)


def hundredths(n: Column) -> Column:
    """``n / 100`` of a whole number, exactly."""
    return n.cast("decimal(36,0)") * F.lit(Decimal("0.01"))


def as_doubles(df: DataFrame) -> DataFrame:
    """``df`` with its decimal columns as ``double``."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields])


def cents(c: Column) -> Column:
    """A money decimal as an exact whole number of cents."""
    return (c * 100).cast(WIDE)


def floor_div(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative integral decimals (no rounding step)."""
    return F.when(b != 0, ((a - F.pmod(a, b)) / b).cast(WIDE))


def half_up_div(n: Column, k: Column) -> Column:
    """``round_half_up(n / k)`` for integral ``n >= 0`` and ``k > 0``; NULL if ``k`` is 0."""
    n, k = n.cast(WIDE), k.cast(WIDE)
    return F.when(k != 0, floor_div(n * 2 + k, k * 2))


def mean_money(total: Column, count: Column) -> Column:
    """Mean of money values rounded half up to cents: ``total / count``."""
    return hundredths(half_up_div(cents(total), count))


def percent_2dp(part: Column, whole: Column, money: bool = False) -> Column:
    """``round(100 * part / whole, 2)``, half up, exact; NULL when ``whole`` is 0."""
    a, b = (cents(part), cents(whole)) if money else (part, whole)
    return hundredths(half_up_div(a.cast(WIDE) * 10000, b))


def percent_basis_points(part: Column, whole: Column) -> Column:
    """``round(10000 * part / whole)`` half up, as an exact integer (for DECIMAL(5,2) casts)."""
    return half_up_div(part.cast(WIDE) * 10000, whole)


def percent_raw(part: Column, whole: Column) -> Column:
    """Unrounded ``100.0 * part / whole`` in double arithmetic."""
    return F.lit(100.0).cast("double") * part / whole

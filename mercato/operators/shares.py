"""Share of the grand total per row.

``x * 100 / SUM(x) OVER ()`` puts every row in one place. Here the total is a
one-row aggregate (partial sums first, so a task sends one number) that the rows read
as a scalar subquery: no window over all rows and no join, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.money import hundredths, percent_2dp, percent_basis_points


def grand_total(df: DataFrame, value: str) -> Column:
    """``SUM(value) OVER ()`` as a scalar subquery over ``df``."""
    return df.agg(F.sum(value).alias("_total")).scalar()


def share_of_total(df: DataFrame, value: str, out: str, money: bool = False) -> DataFrame:
    """``out`` = ``round(100 * value / sum(value), 2)`` half up."""
    return df.withColumn(out, percent_2dp(F.col(value), grand_total(df, value), money=money))


def share_of_total_decimal(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out`` = ``CAST(100.0 * value / sum(value) AS DECIMAL(5,2))`` (half up).

    The cast fails on overflow, as the SQL cast does.
    """
    basis_points = percent_basis_points(F.col(value), grand_total(df, value))
    return df.withColumn(out, hundredths(basis_points).cast("decimal(5,2)"))

"""Running total without a single-partition window.

``SUM(v) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)`` over the whole table puts
every row in one task. Two levels give the same sums in parallel:

* inside a block (a coarse key derived from the order key, e.g. the month of a
  day) a window partitioned by the block computes the running sum;
* what is before the block is a prefix sum over the blocks, made by a tree of block
  sums (:mod:`mercato.operators.prefix`) and joined back on the block, so there may be
  any number of blocks and nothing is broadcast by hand.

The input is read twice (block sums and the in-block window); where it ends in an
aggregate, as in the reports, both readers share its shuffle.

The order key must be unique (one row per day here), as it is in the reports:
with ties a ROWS frame has no defined order anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.prefix import add_known, exclusive_sums

#: The block of a NULL order key: before all others, as NULL sorts first.
_NULL_BLOCK = -(1 << 62)


def _number(df: DataFrame, block: Column) -> Column:
    """``block`` as a bigint in the same order."""
    kind = df.select(block.alias("b")).schema[0].dataType
    if isinstance(kind, T.DateType):
        block = F.unix_date(block)
    elif not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"a block is a date or a whole number, not {kind.simpleString()}")
    return F.coalesce(block.cast("bigint"), F.lit(_NULL_BLOCK))


def running_total(
    df: DataFrame, order_by: str, value: str, out: str, block: Column, levels: int = 1
) -> DataFrame:
    """``df`` plus ``out`` = running sum of ``value`` in ``order_by`` order.

    ``block``, a date or a whole number, must never fall as ``order_by`` rises. NULL
    values are skipped as SQL ``SUM`` does; the running sum is NULL until the first
    non-NULL. ``levels`` is the height of the tree of block sums.
    """
    blocked = df.withColumn("_block", _number(df, block))
    upto_here = Window.partitionBy("_block").orderBy(order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    within = blocked.withColumn("_within", F.sum(value).over(upto_here))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_block_sum"))
    before = exclusive_sums(sums, "_block", "_block_sum", "_before", levels).select("_block", "_before")
    joined = within.join(before, "_block")
    return joined.withColumn(out, add_known("_within", "_before")).drop("_block", "_within", "_before")

"""Prefix sums over any number of ordered blocks: a tree of block sums.

``SUM(v) OVER (ORDER BY block ROWS ... 1 PRECEDING)`` over one row per block is one
task however many blocks there are. Here blocks carry a whole number that rises with
their order; ``2**bits`` consecutive numbers share a parent. A window inside each
parent gives the sum of the blocks before, the parents are summed up the same way, and
what is before the parent is joined back on its number. No window holds more than
``2**bits`` rows but the highest, which holds one row for each ``2**(bits * levels)``
numbers of the range in use, and nothing is broadcast by hand. All of it is lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that share a parent, as a power of two.
FAN_BITS = 16


def add_known(a: str, b: str) -> Column:
    """``a + b`` where a NULL counts as nothing; NULL only where both are."""
    return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col(b))


def exclusive_sums(
    blocks: DataFrame, number: str, value: str, out: str, levels: int = 1, bits: int = FAN_BITS
) -> DataFrame:
    """``blocks`` (one row per ``number``, a bigint) plus ``out``: the sum of ``value``
    over all lower numbers, NULL where there is no known value before."""
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return blocks.withColumn(out, F.sum(value).over(before))
    up, total, inside, upto = (f"_{name}{levels}" for name in ("up", "total", "inside", "upto"))
    within = blocks.withColumn(up, F.shiftright(number, bits)).withColumn(
        inside, F.sum(value).over(before.partitionBy(up))
    )
    parents = blocks.groupBy(F.shiftright(number, bits).alias(up)).agg(F.sum(value).alias(total))
    parents = exclusive_sums(parents, up, total, upto, levels - 1, bits).select(up, upto)
    return within.join(parents, up).withColumn(out, add_known(inside, upto)).drop(up, inside, upto)

"""Ranking operators that keep a global order without a single-partition window.

``dense_rank().over(Window.orderBy(v))`` with no partition key moves every row
into one task (``Exchange SinglePartition``). :func:`global_dense_rank` gives the same
numbers in two passes over the distinct values:

1. every distinct value has a whole-number key that never falls as the value rises (the
   amount in its smallest unit for decimals, the day for dates, ...). Values whose keys
   agree but for the lowest bits form a block and get a local dense rank in a window
   partitioned by the block, so a value held by a third of all rows is one row here and
   a block of whole numbers never has more than ``2**FAN_BITS`` values;
2. the blocks' counts are summed up by :func:`mercato.operators.prefix.exclusive_sums`;
   local rank plus the count of the blocks before is the rank, and rows get it by an
   equi-join on the value. A hot value is one skewed join key; AQE's skew-join split
   handles it (the ranked side has one row per value).

The key is a function of the value alone, so there is no quantile job, nothing is
sampled, and no job runs while the plan is built. The steps read the same shuffles
(of the input's last aggregate, and of the distinct values), which Spark reuses.

:func:`top_k_per_group` is ``row_number() <= k`` per group; Spark inserts a
partial ``WindowGroupLimit`` before the shuffle, so at most ``k`` rows per group
and map task cross the network however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.prefix import FAN_BITS, exclusive_sums

#: Keys of real values stay within this; what is beyond shares the outermost block.
_MOST_KEY = 1 << 61


def order_key(value: str, dtype: T.DataType) -> Column:
    """A bigint that never falls as ``value`` rises (NULL for NULL)."""
    # greatest and least skip NULLs
    return F.when(F.col(value).isNotNull(), _key(F.col(value), dtype))


def _key(v: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        units = (v.cast(f"decimal(38,{dtype.scale})") * F.lit(10**dtype.scale)).cast("decimal(38,0)")
        edge = F.lit(_MOST_KEY).cast("decimal(38,0)")
        return F.greatest(F.least(units, edge), -edge).cast("bigint")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.greatest(F.least(v.cast("bigint"), F.lit(_MOST_KEY)), F.lit(-_MOST_KEY))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(v.cast("date")).cast("bigint") * (1 << FAN_BITS)  # a block is a day
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        size = F.log2(1 + F.least(F.abs(v.cast("double")), F.lit(1e308))) * float(1 << 40)
        key = (F.signum(v) * F.floor(size)).cast("bigint")
        return F.when(F.isnan(v), F.lit(_MOST_KEY)).otherwise(key)  # NaN sorts highest
    raise TypeError(f"no order key for {dtype.simpleString()}")


def global_dense_rank(
    df: DataFrame,
    value: str,
    rank_col: str = "rank",
    descending: bool = True,
    bits: int = FAN_BITS,
) -> DataFrame:
    """``df`` plus ``rank_col`` = ``DENSE_RANK() OVER (ORDER BY value [DESC])``.

    NULL sorts lowest (last when descending, first when ascending), as the SQL
    engines of the reference do.
    """
    key = order_key(value, df.schema[value].dataType)
    key = F.coalesce(-key if descending else key, F.lit(2 * _MOST_KEY if descending else -2 * _MOST_KEY))
    block = F.shiftright(key, bits)
    values = df.select(value).distinct().select(F.col(value).alias("_rv"), block.alias("_block"))
    order = F.col("_rv").desc() if descending else F.col("_rv").asc()
    local = values.withColumn("_local", F.dense_rank().over(Window.partitionBy("_block").orderBy(order)))
    counts = values.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = exclusive_sums(counts, "_block", "_n", "_before", levels=2, bits=bits)
    ranked = local.join(offsets.select("_block", "_before"), "_block").select(
        "_rv", (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("bigint").alias(rank_col)
    )
    return df.join(ranked, df[value].eqNullSafe(ranked["_rv"])).drop("_rv")


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1
) -> DataFrame:
    """Rows ranked ``<= k`` in each group by ``order`` (ties broken by the later keys)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn")

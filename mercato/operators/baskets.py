"""Co-occurrence counts of item pairs within baskets.

The reference counts ``COUNT(*)`` over a self-join of order lines on the order
with ``a.item < b.item``: two lines of A and one of B in one order count 2. The
same number comes from the (basket, item) multiplicities ``q``:

    count(A, B) = sum over baskets of q(A) * q(B)

so lines are first aggregated to one row per (basket, item), map-side combined.

Skew: the self-join on the basket key emits ``d^2 / 2`` candidate pairs for a
basket with ``d`` distinct items, all in the task that owns the basket. Big
baskets are therefore split into ``S = ceil(n / block_items)`` blocks by a hash
of the item, where ``n >= d`` is the basket's number of lines; the pair of blocks ``(b1, b2)`` becomes part of the join key, each
row is copied to the ``S`` block pairs it takes part in, and each join key then
holds at most about ``block_items`` rows per side. Ordinary baskets have ``S=1``
and are not copied. Each item pair still meets exactly once (in block pair
``(block(A), block(B))``), so the counts are exact; nothing is capped or sampled.

Only baskets of more than ``block_items`` lines enter the size table; all others
have ``S = 1`` without a match. The table is left-joined on the basket and a salt
of the item, with its few rows repeated once a salt, so a hot basket is dealt over
``SALTS`` join keys. Neither that join nor the quadratic part depends on AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_ITEMS = 2048
#: Join keys that the items of one basket are dealt over when its size is attached.
SALT_BITS = 6
SALTS = 1 << SALT_BITS


def pair_counts(
    df: DataFrame,
    basket: str,
    item: str,
    first: str = "item_1",
    second: str = "item_2",
    count: str = "times_together",
    block_items: int = DEFAULT_BLOCK_ITEMS,
) -> DataFrame:
    # a NULL item never pairs (NULL < x is unknown); saying so up front also keeps
    # the two branches below identical, so Spark reuses the aggregate's shuffle and
    # the lines are scanned once
    known = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    qty = known.groupBy(basket, item).agg(F.count(F.lit(1)).alias("_q"))
    # basket size measured in lines (sum of multiplicities, >= distinct items, so a
    # block never holds more than block_items items); reading _q keeps this branch's
    # (basket, item) aggregate identical to the pair branch's
    sizes = qty.groupBy(basket).agg(F.sum("_q").alias("_d")).where(F.col("_d") > block_items)
    split = sizes.select(
        basket,
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
        F.ceil(F.col("_d") / F.lit(block_items)).cast("int").alias("_s"),
    )
    # the salt takes the hash's upper bits, the block its remainder: they are independent
    sized = (
        qty.withColumn("_salt", F.shiftrightunsigned(F.xxhash64(item), 64 - SALT_BITS).cast("int"))
        .join(split, [basket, "_salt"], "left")
        .withColumn("_s", F.coalesce("_s", F.lit(1)))
        .withColumn("_blk", F.pmod(F.xxhash64(item), F.col("_s")).cast("int"))
    )
    every_block = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))

    left = sized.select(
        F.col(basket).alias("_basket"),
        F.col("_blk").alias("_b1"),
        every_block.alias("_b2"),
        F.col(item).alias(first),
        F.col("_q").alias("_q1"),
    )
    right = sized.select(
        F.col(basket).alias("_basket"),
        every_block.alias("_b1"),
        F.col("_blk").alias("_b2"),
        F.col(item).alias(second),
        F.col("_q").alias("_q2"),
    )
    pairs = left.join(right, ["_basket", "_b1", "_b2"]).where(F.col(first) < F.col(second))
    return pairs.groupBy(first, second).agg(
        F.sum(F.col("_q1") * F.col("_q2")).alias(count)
    )

"""Helpers the operators share: tables in the shared folder, and joins that
survive a hot key."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import bound_batches, checkpoint_dir, ship_package

#: Keys that ``attach`` treats as hot: the largest groups, whatever their size.
#: Beyond the 1,000 largest no key can hold more than a thousandth of the rows.
HOT_KEYS = 1_000
#: Pieces each hot key is dealt into.
SPREAD = 64


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)``, run after the workers have got this package, with
    batches of bounded size on the way to them."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return query(spark, *args)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def keeping() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that computes a table once and keeps it on the executors' disks
    until the block ends. For tables that no result reads later: no file is written to
    the shared folder, and a lost executor costs its part of the table anew."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return df

    try:
        yield keep
    finally:
        for df in reversed(kept):  # those that were made of others first
            df.unpersist()


def fewer(df: DataFrame, tasks: int) -> DataFrame:
    """``df``, which takes ``tasks`` tasks, in half of them, but in one for each core at
    least: each task that writes has a file, its checksum and a folder made for it."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-tasks // 2)))


def hashed_sample(df: DataFrame, columns: list[str], total: int, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` (``total`` in number) with the least hash of
    ``columns``. Only about that many are sorted: the hash is uniform, so those with a
    larger one are left out first."""
    h = F.xxhash64(*columns)
    if total > rows:
        df = df.filter((h / F.lit(2.0**64) + 0.5) * total <= 1.2 * rows + 1_000)
    return df.orderBy(h, *columns).limit(rows)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, spread_by: list[str], how: str = "left") -> DataFrame:
    """Join ``groups`` (one row per key, ``weight`` = its rows) to ``rows``.

    The ``HOT_KEYS`` heaviest keys, a table of fixed size, are broadcast as
    marks; rows of a marked key are dealt into ``SPREAD`` pieces by the hash of
    ``spread_by`` and the key's group row is repeated for each piece, so no key
    ends in one task. Null keys match null keys. ``groups`` should be a saved
    table: it is read twice.
    """
    names = [c for c in groups.columns if c not in keys]
    # every side gets names of its own, as the three may share columns
    n = range(len(keys))
    hot = groups.orderBy(F.desc(weight), *keys).limit(HOT_KEYS).select(*[F.col(k).alias(f"__hot{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot"))
    left = rows.select("*", *[F.col(k).alias(f"__left{i}") for i, k in enumerate(keys)])
    right = groups.select(*[F.col(k).alias(f"__right{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__value_{c}") for c in names])

    def on(a: str, b: str) -> Column:
        cond = F.lit(True)
        for i in n:
            cond = cond & F.col(f"__{a}{i}").eqNullSafe(F.col(f"__{b}{i}"))
        return cond

    left = left.join(F.broadcast(hot), on("left", "hot"), "left")
    left = left.withColumn("__piece", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")).drop("__hot", *[f"__hot{i}" for i in n])
    right = right.join(F.broadcast(hot), on("right", "hot"), "left")
    pieces = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = right.select(*[f"__right{i}" for i in n], *[f"__value_{c}" for c in names], F.explode(pieces).alias("__at"))
    found = left.join(right, on("left", "right") & (F.col("__piece") == F.col("__at")), how)
    return found.select(*rows.columns, *[F.col(f"__value_{c}").alias(c) for c in names])

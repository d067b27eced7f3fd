"""All 36 reports stay exact when one person and one order hold a third of the rows.

The skewed copy is derived from the sf0.001 tables with Spark: every third order is
moved to one customer key (a hot person), every third order line is moved to one
order key (a hot basket with many distinct products), and a third of the lines to
one seller key (a hot seller). Both engines then read
the same files. The large tables are written as several files, so the shuffles
have several map outputs and AQE can split a skewed partition.
"""

from __future__ import annotations

import pytest
from conftest import SF001
from oracle_harness import compare, duck
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from mercato.functions.money import as_doubles
from mercato.plans import REPORTS
from mercato.sources import load_tables

HOT_CUSTOMER = 7
HOT_ORDER = 11
HOT_SELLER = 3


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    for name in ("customer", "nation", "part", "supplier", "region"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(str(root / f"{name}.parquet"))
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    orders.withColumn(
        "o_custkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT_CUSTOMER).cast("bigint")).otherwise(
            F.col("o_custkey")
        ),
    ).repartition(8).write.parquet(str(root / "orders.parquet"))
    lines = spark.read.parquet(f"{SF001}/lineitem.parquet")
    lines.withColumn(
        "l_orderkey",
        F.when(F.col("l_partkey") % 3 == 0, F.lit(HOT_ORDER).cast("bigint")).otherwise(
            F.col("l_orderkey")
        ),
    ).withColumn(
        "l_suppkey",
        F.when(F.col("l_linenumber") % 3 == 1, F.lit(HOT_SELLER).cast("bigint")).otherwise(
            F.col("l_suppkey")
        ),
    ).repartition(8).write.parquet(str(root / "lineitem.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def skewed_duck(skewed_dir):
    return duck(skewed_dir)


def test_fixture_is_skewed(spark, skewed_dir):
    lines = spark.read.parquet(f"{skewed_dir}/lineitem.parquet")
    hot = lines.where(F.col("l_orderkey") == HOT_ORDER).count()
    assert hot * 4 > lines.count()
    hot_seller = lines.where(F.col("l_suppkey") == HOT_SELLER).count()
    assert hot_seller * 4 > lines.count()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_exact_under_skew(spark, skewed_dir, skewed_duck, name):
    r = compare(spark, skewed_dir, name, queries(), oracle_sql(), skewed_duck)
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


FORCED_SKEW = {
    # no broadcasts, so the hot keys meet in shuffled joins
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    # treat anything above a few KB and 1.5x the median as skewed
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
SKEW_SENSITIVE = [
    "items_sold_by_category",
    "repeat_items_by_category",
    "customer_spend",
    "repeat_pct_by_state",
    "seller_repeat_dependency",
]


@pytest.fixture
def forced_skew(spark):
    previous = {k: spark.conf.get(k, None) for k in FORCED_SKEW}
    for k, v in FORCED_SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in previous.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", SKEW_SENSITIVE)
def test_aqe_splits_hot_keys_and_results_stay_exact(spark, skewed_dir, skewed_duck, forced_skew, name):
    """Each report on its own, from the files alone."""
    df = as_doubles(REPORTS[name](load_tables(spark, skewed_dir)))
    r = compare(spark, skewed_dir, name, {name: lambda *_: df}, oracle_sql(), skewed_duck)
    assert r["values_match"] and r["spark_rows"] == r["oracle_rows"], r
    assert "skewed" in df._jdf.queryExecution().executedPlan().toString()


def test_rank_join_splits_a_hot_value(spark, forced_skew):
    import random
    from decimal import Decimal

    from pyspark.sql import Window

    from mercato.operators import global_dense_rank

    rng = random.Random(1)
    rows = [
        (f"k{i}", Decimal("500.00") if i % 3 == 0 else Decimal(rng.randint(0, 10**6)) / 100)
        for i in range(60000)
    ]
    df = spark.createDataFrame(rows, "k string, v decimal(18,2)").repartition(8)
    got = global_dense_rank(df, "v", "r").select(
        "k", F.col("r").cast("int").alias("r")
    )
    ranks = sorted(map(tuple, got.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    window = df.withColumn("r", F.dense_rank().over(Window.orderBy(F.desc("v"))))
    assert ranks == sorted(map(tuple, window.select("k", "r").collect()))
    assert "isFinalPlan=true" in plan and plan.count("skewed") > 0

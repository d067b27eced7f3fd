"""Each scale-safe operator equals the literal (single-task) formulation it replaces.

Data are skewed on purpose: one key or value holds about a third of all rows,
there are NULLs and duplicates, and block/bucket sizes are set small so the
splitting paths run.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators import (
    exclusive_sums,
    global_dense_rank,
    pair_counts,
    previous_event,
    running_total,
    top_k_per_group,
)


def _rows(df):
    # repr as the sort key: rows may hold NULLs next to dates or numbers
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed_values(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            v = Decimal("500.00")  # the hot value: a third of all rows
        elif i % 97 == 0:
            v = None
        else:
            v = Decimal(rng.randint(0, 40000)) / 100
        rows.append((f"k{i}", v))
    schema = T.StructType(
        [T.StructField("k", T.StringType()), T.StructField("v", T.DecimalType(18, 2))]
    )
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("bits", [2, 10, 16])
def test_global_dense_rank_equals_window(skewed_values, descending, bits):
    order = F.col("v").desc() if descending else F.col("v").asc()
    expected = skewed_values.withColumn("r", F.dense_rank().over(Window.orderBy(order)))
    got = global_dense_rank(skewed_values, "v", "r", descending=descending, bits=bits)
    assert _rows(got.select("k", "v", F.col("r").cast("int"))) == _rows(expected)


@pytest.mark.parametrize("descending", [True, False])
def test_global_dense_rank_on_doubles_with_nan_and_infinity(spark, descending):
    rng = random.Random(9)
    specials = [float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0]
    rows = [(i, rng.choice(specials) if i % 7 == 0 else rng.uniform(-1e6, 1e6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v double")
    order = F.col("v").desc() if descending else F.col("v").asc()
    expected = df.withColumn("r", F.dense_rank().over(Window.orderBy(order)))
    got = global_dense_rank(df, "v", "r", descending=descending)
    key = lambda r: (r[0], r[2])  # noqa: E731  (NaN != NaN, compare ids and ranks)
    assert sorted(map(key, got.select("k", "v", F.col("r").cast("int")).collect())) == sorted(
        map(key, expected.collect())
    )


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize(
    ("kind", "make"),
    [
        ("decimal(38,6)", lambda r: Decimal(r.choice([-1, 1]) * r.randint(0, 10**30)) / 10**6),
        ("decimal(38,0)", lambda r: Decimal(r.choice([2**61, 2**61 + 1, 2**62, -(2**61), -(10**37), 10**37, 0, 1]))),
        ("bigint", lambda r: r.choice([r.randint(-(2**63), 2**63 - 1), 2**63 - 1, -(2**63), r.randint(-9, 9)])),
        ("int", lambda r: r.randint(-300, 300)),
        ("date", lambda r: dt.date(1900 + r.randint(0, 200), r.randint(1, 12), 3)),
        ("timestamp_ntz", lambda r: dt.datetime(1969, 12, 30 + r.randint(0, 1), r.randint(0, 23), 0, 0, r.randint(0, 99))),
        ("float", lambda r: float(r.randint(-8, 8)) / 4),
    ],
)
def test_global_dense_rank_of_every_type(spark, kind, make, descending):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, None if i % 50 == 0 else make(rng)) for i in range(500)], f"k int, v {kind}")
    order = F.col("v").desc() if descending else F.col("v").asc()
    expected = df.withColumn("r", F.dense_rank().over(Window.orderBy(order)))
    got = global_dense_rank(df, "v", "r", descending=descending)
    assert _rows(got.select("k", "v", F.col("r").cast("int"))) == _rows(expected)


def test_no_type_without_an_order_key(spark):
    with pytest.raises(TypeError):
        global_dense_rank(spark.createDataFrame([("a",)], "v string"), "v")


def test_no_job_starts_while_a_plan_is_built(spark, micro):
    """Rank, lag, running total and shares are lazy through and through."""
    from mercato.plans import REPORTS

    sc = spark.sparkContext
    try:
        sc.setJobGroup("building", "plans")
        plans = [REPORTS[n](micro) for n in ("customer_revenue_rank", "delivery_gap_days", "cumulative_revenue", "order_frequency_buckets", "revenue_by_payment_type")]
        assert not sc.statusTracker().getJobIdsForGroup("building")
        plans[0].collect()
        assert sc.statusTracker().getJobIdsForGroup("building")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


@pytest.mark.parametrize(("levels", "bits"), [(0, 16), (1, 3), (2, 2), (4, 4)])
def test_exclusive_sums(spark, levels, bits):
    """Sparse and negative block numbers, NULL sums, at every height of the tree."""
    rng = random.Random(8)
    numbers = sorted({rng.choice([rng.randint(-60, 60), rng.randint(-(2**40), 2**40)]) for _ in range(200)})
    rows = [(n, None if i < 3 or rng.random() < 0.2 else rng.randint(-50, 50)) for i, n in enumerate(numbers)]
    got = exclusive_sums(spark.createDataFrame(rows, "b bigint, s bigint"), "b", "s", "before", levels, bits)
    want, known = [], []
    for n, s in rows:
        want.append((n, s, sum(known) if known else None))
        known += [s] if s is not None else []
    assert got.columns == ["b", "s", "before"] and sorted(map(tuple, got.collect())) == want


def test_running_total_over_a_million_blocks(spark):
    """One row a block: the tree has windows of at most 65,536 rows."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select("id", F.lit(3).cast("bigint").alias("v"))
    got = running_total(df, "id", "v", "run", F.col("id"))
    wrong = got.where(F.col("run") != (F.col("id") + 1) * 3).count()
    assert wrong == 0 and got.count() == n


def test_shares_without_a_window_over_all_rows(spark):
    from mercato.operators import share_of_total

    df = spark.range(1, 100_001, numPartitions=8).select("id", (F.col("id") % 7 + 1).alias("v"))
    got = share_of_total(df, "v", "pct")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    # only the partial sums meet in one partition
    assert all("partial_sum" in below for below in plan.split("Exchange SinglePartition")[1:])
    total = sum(i % 7 + 1 for i in range(1, 100_001))
    assert {(r["v"], r["pct"]) for r in got.collect()} == {(v, round(100 * v / total, 2)) for v in range(1, 8)}


@pytest.fixture(scope="module")
def baskets(spark):
    rng = random.Random(11)
    rows = []
    # one hot basket holding about a third of all lines, many distinct items
    for _ in range(600):
        rows.append(("hot", f"p{rng.randint(0, 150):03d}"))
    for b in range(300):
        for _ in range(rng.randint(1, 6)):
            rows.append((f"b{b}", f"p{rng.randint(0, 40):03d}"))
    return spark.createDataFrame(rows, "basket string, item string")


@pytest.mark.parametrize("block_items", [4, 50, 2048])
def test_pair_counts_equals_self_join(baskets, block_items):
    a, b = baskets.alias("a"), baskets.alias("b")
    naive = (
        a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a.item") < F.col("b.item")))
        .groupBy(F.col("a.item").alias("item_1"), F.col("b.item").alias("item_2"))
        .agg(F.count(F.lit(1)).alias("times_together"))
    )
    got = pair_counts(baskets, "basket", "item", block_items=block_items)
    assert _rows(got) == _rows(naive)


def test_running_total_equals_window(spark):
    rng = random.Random(3)
    start = dt.date(2016, 1, 1)
    rows = []
    for d in range(0, 900, 2):
        v = None if d % 50 == 0 else Decimal(rng.randint(0, 100000)) / 100
        rows.append((start + dt.timedelta(days=d), v))
    df = spark.createDataFrame(rows, "day date, v decimal(18,2)")
    frame = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.withColumn("run", F.sum("v").over(frame))
    got = running_total(df, "day", "v", "run", F.trunc("day", "month"))
    assert _rows(got.select("day", "v", "run")) == _rows(expected)


def test_running_total_with_null_order_key(spark):
    df = spark.createDataFrame(
        [(None, 4), (dt.date(2020, 1, 5), 1), (dt.date(2020, 3, 1), 2)], "day date, v int"
    )
    frame = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.withColumn("run", F.sum("v").over(frame))
    got = running_total(df, "day", "v", "run", F.trunc("day", "month"))
    assert _rows(got.select("day", "v", "run")) == _rows(expected)


def test_running_total_leading_nulls(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 1, 1), None), (dt.date(2020, 2, 1), None), (dt.date(2020, 2, 3), 5)],
        "day date, v int",
    )
    got = running_total(df, "day", "v", "run", F.trunc("day", "month"))
    assert [r.run for r in got.orderBy("day").collect()] == [None, None, 5]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    base = dt.datetime(2017, 1, 1)
    rows = []
    for i in range(2400):
        key = "hot" if i % 3 == 0 else f"u{rng.randint(0, 120)}"
        # coarse times so that duplicates and several events per day occur
        t = base + dt.timedelta(hours=6 * rng.randint(0, 400))
        rows.append((key, t))
    rows += [("dup", base)] * 9  # one timestamp many times
    rows += [("hot", None), ("hot", None), ("nulls_only", None)]  # NULL timestamps
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz")


@pytest.mark.parametrize("chunk", [2, 4096])
def test_previous_event_equals_lag(events, chunk):
    w = Window.partitionBy("key").orderBy("ts")
    expected = (
        events.withColumn("prev", F.lag("ts").over(w))
        .where(F.col("prev").isNotNull())
        .select("key", "prev", "ts")
    )
    got = previous_event(events, "key", "ts", prev="prev", chunk=chunk)
    assert _rows(got) == _rows(expected)


def test_top_k_per_group(spark):
    rows = [("a", i, i % 7) for i in range(50)] + [("b", i, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id int, score int")
    got = top_k_per_group(df, ["g"], [F.desc("score"), F.asc("id")], k=2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 6, 6), ("a", 13, 6), ("b", 0, 3), ("b", 1, 3)]


def test_pair_counts_with_null_items_and_baskets(spark):
    rows = [("b1", "x"), ("b1", None), ("b1", "y"), (None, "x"), (None, "y"), ("b2", None)]
    rows += [("b2", "x"), ("b2", "y"), ("b2", "y"), ("b3", "z")]
    df = spark.createDataFrame(rows, "basket string, item string")
    a, b = df.alias("a"), df.alias("b")
    naive = (
        a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a.item") < F.col("b.item")))
        .groupBy(F.col("a.item").alias("item_1"), F.col("b.item").alias("item_2"))
        .agg(F.count(F.lit(1)).alias("times_together"))
    )
    got = pair_counts(df, "basket", "item", block_items=1)
    assert _rows(got) == _rows(naive) == [("x", "y", 3)]


def test_running_total_with_an_all_null_block(spark):
    rows = [(dt.date(2020, 1, 3), 2), (dt.date(2020, 2, 1), None), (dt.date(2020, 2, 9), None)]
    rows += [(dt.date(2020, 3, 4), 5), (dt.date(2020, 3, 5), None), (dt.date(2020, 4, 1), 1)]
    df = spark.createDataFrame(rows, "day date, v int")
    frame = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.withColumn("run", F.sum("v").over(frame))
    got = running_total(df, "day", "v", "run", F.trunc("day", "month"))
    assert _rows(got.select("day", "v", "run")) == _rows(expected)


def test_repeated_rows_of_one_order_do_not_make_a_repeat_person(spark):
    from mercato.operators.segments import of_repeat_persons

    rows = [("a", "p"), ("a", "p"), ("b", "q"), ("c", "q"), ("d", None), ("e", None), (None, "r"), ("f", "r")]
    df = spark.createDataFrame(rows, "order_id string, customer_unique_id string")
    got = {r["order_id"] for r in of_repeat_persons(df).collect() if r["order_id"]}
    assert got == {"b", "c"}


def test_pair_counts_deals_a_hot_basket_over_salts(spark):
    from pyspark.sql import functions as F

    from mercato.operators.baskets import pair_counts

    lines = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("basket"), (F.col("id") % 101).alias("item")
    )
    got = pair_counts(lines, "basket", "item", block_items=64)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("_salt" in line for line in plan.split("\n") if "Join LeftOuter" in line)
    a, b = lines.alias("a"), lines.alias("b")
    want = (
        a.join(b, F.expr("a.basket = b.basket AND a.item < b.item"))
        .groupBy(F.col("a.item"), F.col("b.item"))
        .count()
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

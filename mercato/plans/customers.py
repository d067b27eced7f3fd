"""Section 2, customer behaviour: spend, one-time vs repeat, rank, lifetime, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import as_money, day_gap, mean_money, percent_raw
from mercato.functions.money import floor_div
from mercato.operators.gaps import previous_event
from mercato.operators.ranking import global_dense_rank
from mercato.operators.shares import share_of_total_decimal
from mercato.operators.segments import (
    PERSON,
    delivered,
    order_values,
    orders_of_persons,
    person_order_counts,
)
from mercato.sources import Tables

# fixed values: labels of the customer-type report
ONE_TIME_BUYER = "One-time buyer"
REPEAT_CUSTOMER = "Repeat customer"
# fixed values: order-frequency groups as (label, sort key, order count);
# the last group takes every count from its order count up
FREQUENCY_GROUPS = (("1 Order", 1, 1), ("2 Orders", 2, 2), ("3 Orders", 3, 3), ("4+ Orders", 4, 4))


def customer_spend(t: Tables) -> DataFrame:
    """Delivered spend (price + freight) per person, biggest first."""
    return (
        order_values(t)
        .groupBy(PERSON)
        .agg(as_money(F.sum("order_revenue")).alias("total_money_spent"))
        .orderBy(F.desc("total_money_spent"), PERSON)
    )


def customer_type(t: Tables) -> DataFrame:
    """Orders per person over every status, labelled one-time or repeat."""
    counts = person_order_counts(t, delivered_only=False, with_items=False)
    label = F.when(F.col("total_orders") == 1, ONE_TIME_BUYER).otherwise(REPEAT_CUSTOMER)
    return counts.withColumn("customer_type", label).orderBy(F.desc("total_orders"), PERSON)


def repeat_customer_pct(t: Tables) -> DataFrame:
    """Share of persons with more than one order (every status), unrounded."""
    counts = person_order_counts(t, delivered_only=False, with_items=False)
    repeaters = F.sum(F.when(F.col("total_orders") > 1, 1).otherwise(0))
    return counts.agg(
        percent_raw(repeaters, F.count(F.lit(1))).alias("repeat_customer_percentage")
    )


def avg_orders_repeat(t: Tables, truncate: bool = True) -> DataFrame:
    """Mean order count of repeat persons.

    By default an integer average (truncated), as the reference's ``AVG`` over an
    integer column gives; ``truncate=False`` returns the exact mean as ``double``.
    """
    counts = person_order_counts(t, delivered_only=False, with_items=False)
    repeat = counts.where(F.col("total_orders") > 1)
    if truncate:
        mean = floor_div(F.sum("total_orders"), F.count("total_orders")).cast("bigint")
    else:
        mean = F.avg("total_orders")
    return repeat.agg(mean.alias("avg_order_repeat_customers"))


def _person_revenue_all_statuses(t: Tables) -> DataFrame:
    # every status, only orders that have lines
    return (
        order_values(t, delivered_only=False)
        .groupBy(PERSON)
        .agg(F.sum("order_revenue").alias("_revenue"), F.count(F.lit(1)).alias("_orders"))
    )


def avg_revenue_repeat(t: Tables) -> DataFrame:
    """Mean lifetime revenue of persons with more than one order that has lines."""
    persons = _person_revenue_all_statuses(t).where(F.col("_orders") > 1)
    return persons.agg(
        mean_money(F.sum("_revenue"), F.count("_revenue")).alias("avg_evenue_repeat_customer")
    )


def avg_revenue_one_time(t: Tables) -> DataFrame:
    """Mean lifetime revenue of persons with exactly one order that has lines."""
    persons = _person_revenue_all_statuses(t).where(F.col("_orders") == 1)
    return persons.agg(
        mean_money(F.sum("_revenue"), F.count("_revenue")).alias("avg_Revenue_one_time_customer")
    )


def customer_revenue_rank(t: Tables) -> DataFrame:
    """Dense rank of persons by rounded delivered revenue, highest first."""
    revenue = (
        order_values(t)
        .groupBy(PERSON)
        .agg(F.round(F.sum("order_revenue"), 2).alias("_lifetime"))
    )
    ranked = global_dense_rank(revenue, "_lifetime", "revenue_rank")
    return ranked.select(
        PERSON,
        F.col("_lifetime").alias("lifetime_revenue"),
        "revenue_rank",
    ).orderBy("revenue_rank", PERSON)


def customer_first_last_order(t: Tables) -> DataFrame:
    """First and last purchase timestamp of each person's delivered orders."""
    ts = F.col("order_purchase_timestamp")
    return (
        orders_of_persons(t)
        .groupBy(PERSON)
        .agg(F.min(ts).alias("old"), F.max(ts).alias("latest"))
        .orderBy(PERSON)
    )


def _person_deliveries(t: Tables) -> DataFrame:
    orders = delivered(t.orders).where(F.col("order_delivered_customer_date").isNotNull())
    return orders.join(t.customers, "customer_id").select(
        PERSON, "order_delivered_customer_date"
    )


def delivery_gap_days(t: Tables) -> DataFrame:
    """Days between consecutive delivery dates of each person (first delivery has none)."""
    pairs = previous_event(
        _person_deliveries(t),
        PERSON,
        "order_delivered_customer_date",
        prev="previous_delivered_date",
    )
    return pairs.select(
        PERSON,
        "previous_delivered_date",
        F.col("order_delivered_customer_date").alias("current_delivered_date"),
        day_gap(F.col("previous_delivered_date"), F.col("order_delivered_customer_date")).alias(
            "gap_days"
        ),
    ).orderBy(F.desc("gap_days"), PERSON, "current_delivered_date")


def customer_lifetime_days(t: Tables) -> DataFrame:
    """Days from first to last delivery per person (0 for a single delivery)."""
    d = F.col("order_delivered_customer_date")
    return (
        _person_deliveries(t)
        .groupBy(PERSON)
        .agg(F.min(d).alias("first_delivered_date"), F.max(d).alias("last_delivered_date"))
        .withColumn(
            "lifetime_days", day_gap(F.col("first_delivered_date"), F.col("last_delivered_date"))
        )
        .orderBy(F.desc("lifetime_days"), PERSON)
    )


def order_frequency_buckets(t: Tables) -> DataFrame:
    """Persons with 1, 2, 3, 4+ delivered orders, and their share (DECIMAL(5,2))."""
    counts = person_order_counts(t, delivered_only=True, with_items=False)
    n = F.col("total_orders")
    label, key = None, None
    for name, sort_key, upto in FREQUENCY_GROUPS[:-1]:
        label = (F.when(n == upto, name) if label is None else label.when(n == upto, name))
        key = F.when(n == upto, sort_key) if key is None else key.when(n == upto, sort_key)
    label = label.otherwise(FREQUENCY_GROUPS[-1][0])
    key = key.otherwise(FREQUENCY_GROUPS[-1][1])
    groups = counts.groupBy(label.alias("order_frequency_group"), key.alias("_sort")).agg(
        F.count(F.lit(1)).alias("number_of_customers")
    )
    return (
        share_of_total_decimal(groups, "number_of_customers", "percentage")
        .orderBy("_sort")
        .select("order_frequency_group", "number_of_customers", "percentage")
    )


QUERIES = {
    "customer_spend": customer_spend,
    "customer_type": customer_type,
    "repeat_customer_pct": repeat_customer_pct,
    "avg_orders_repeat": avg_orders_repeat,
    "avg_revenue_repeat": avg_revenue_repeat,
    "avg_revenue_one_time": avg_revenue_one_time,
    "customer_revenue_rank": customer_revenue_rank,
    "customer_first_last_order": customer_first_last_order,
    "delivery_gap_days": delivery_gap_days,
    "customer_lifetime_days": customer_lifetime_days,
    "order_frequency_buckets": order_frequency_buckets,
}

"""Section 4, revenue and value: order value by segment, seller and category,
running revenue, payment mix and weekday revenue.

Order value (definition (d)): per delivered order that has lines, the sum of
price + freight, with the person who placed it. A repeat person has more than
one such order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import as_money, mean_money, weekday_name
from mercato.operators.running import running_total
from mercato.operators.shares import share_of_total
from mercato.operators.segments import (
    CATEGORY,
    PERSON,
    delivered,
    delivered_order_revenue,
    in_english,
    of_repeat_persons,
    order_values,
    with_raw_category,
)
from mercato.sources import Tables

# fixed values: segment labels of the order-value report
REPEAT_SEGMENT = "Repeat Customer"
ONE_TIME_SEGMENT = "One-Time Customer"


def _order_value(t: Tables) -> DataFrame:
    return order_values(t).select(PERSON, "order_id", F.col("order_revenue").alias("order_total"))


def _repeat_order_value(t: Tables) -> DataFrame:
    if t.repeated_ids:  # an order may be of several persons
        values = _order_value(t)
        orders = values.groupBy(PERSON).agg(F.count("order_id").alias("_orders"))
        repeat = orders.where(F.col("_orders") > 1).select(PERSON)
        return values.join(repeat, PERSON, "left_semi").select("order_id", "order_total", PERSON)
    return of_repeat_persons(_order_value(t)).select("order_id", "order_total")


def aov_by_segment(t: Tables) -> DataFrame:
    """Mean order value of repeat vs one-time persons (two-level aggregate, no join back)."""
    known = _order_value(t).filter(F.col(PERSON).isNotNull())
    per_person = known.groupBy(PERSON).agg(
        F.count("order_id").alias("_orders"),
        F.sum("order_total").alias("_total"),
        F.count("order_total").alias("_valued"),
    )
    segment = F.when(F.col("_orders") > 1, REPEAT_SEGMENT).otherwise(ONE_TIME_SEGMENT)
    return per_person.groupBy(segment.alias("customer_segment")).agg(
        mean_money(F.sum("_total"), F.sum("_valued")).alias("AOV")
    )


def repeat_aov_by_seller(t: Tables) -> DataFrame:
    """Mean order total of repeat persons' orders per seller, one vote per seller line.

    As in the reference, the order total is joined back to every line of the
    order, so an order with three lines of a seller counts three times; the mean
    is taken over those lines (map-side partial sums per seller).
    """
    lines = t.items.select("order_id", "seller_id").join(_repeat_order_value(t), "order_id")
    return (
        lines.groupBy("seller_id")
        .agg(
            mean_money(F.sum("order_total"), F.count("order_total")).alias(
                "AOV_from_repeat_customers"
            )
        )
        .orderBy(F.desc("AOV_from_repeat_customers"), "seller_id")
    )


def repeat_aov_by_category(t: Tables) -> DataFrame:
    """Mean order total of repeat persons' orders per category, each order once per category.

    Lines of repeat orders carry their order total; (order, product) and then
    (order, category) are de-duplicated before the mean, as the reference's
    DISTINCT bridge does. The repeat order values are referenced once.
    """
    values = _repeat_order_value(t)
    order_products = t.items.select("order_id", "product_id").join(values, "order_id").distinct()
    own = with_raw_category(order_products, t).select(CATEGORY, *values.columns).distinct()
    order_categories = in_english(own, t).distinct()
    return (
        order_categories.groupBy("product_category")
        .agg(
            mean_money(F.sum("order_total"), F.count("order_total")).alias(
                "AOV_from_repeat_customers"
            )
        )
        .orderBy(F.desc("AOV_from_repeat_customers"), "product_category")
    )


def cumulative_revenue(t: Tables) -> DataFrame:
    """Delivered revenue per purchase day and its running total (two-level, month blocks)."""
    daily = (
        delivered_order_revenue(t)
        .groupBy(F.to_date("order_purchase_timestamp").alias("order_date"))
        .agg(F.round(F.sum("order_revenue"), 2).alias("_revenue"))
    )
    running = running_total(daily, "order_date", "_revenue", "_cumulative", F.trunc("order_date", "month"))
    return running.select(
        "order_date",
        F.col("_revenue").alias("revenue"),
        as_money(F.col("_cumulative")).alias("cumulative_revenue"),
    ).orderBy("order_date")


def revenue_by_payment_type(t: Tables) -> DataFrame:
    """Payment value, distinct orders and revenue share per payment type (delivered).

    Payments meet the delivered orders first (one shuffle on the order), are then
    summed per (order, type) on the same partitioning, and only then per type; the
    distinct-order count is the number of (order, type) rows.
    """
    paid = t.payments.join(
        delivered(t.orders).select("order_id"), "order_id", "inner" if t.repeated_ids else "left_semi"
    )
    per_order_type = paid.groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("_value")
    )
    per_type = per_order_type.groupBy("payment_type").agg(
        F.sum("_value").alias("_total"), F.count(F.lit(1)).alias("total_orders")
    )
    return (
        share_of_total(per_type, "_total", "revenue_share_percent", money=True)
        .select(
            "payment_type",
            as_money(F.col("_total")).alias("total_revenue"),
            "total_orders",
            "revenue_share_percent",
        )
        .orderBy(F.desc("total_revenue"), "payment_type")
    )


def revenue_by_weekday(t: Tables) -> DataFrame:
    """Delivered revenue per English weekday name of purchase."""
    return (
        delivered_order_revenue(t)
        .groupBy(weekday_name(F.col("order_purchase_timestamp")).alias("day_of_week"))
        .agg(as_money(F.sum("order_revenue")).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "day_of_week")
    )


QUERIES = {
    "aov_by_segment": aov_by_segment,
    "repeat_aov_by_seller": repeat_aov_by_seller,
    "repeat_aov_by_category": repeat_aov_by_category,
    "cumulative_revenue": cumulative_revenue,
    "revenue_by_payment_type": revenue_by_payment_type,
    "revenue_by_weekday": revenue_by_weekday,
}

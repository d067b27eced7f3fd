"""Section 1, platform overview: orders and revenue by state, category and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import as_money, calendar_month, calendar_year, year_month
from mercato.operators.segments import (
    count_orders,
    delivered,
    delivered_lines,
    delivered_order_revenue,
    order_totals,
    total_by_category,
)
from mercato.sources import Tables


def orders_by_state(t: Tables) -> DataFrame:
    """Delivered orders per customer state, busiest first."""
    return (
        delivered(t.orders)
        .join(t.customers, "customer_id")
        .groupBy("customer_state")
        .agg(F.count("order_id").alias("total_orders"))
        .orderBy(F.desc("total_orders"), "customer_state")
    )


def _state_revenue(t: Tables) -> DataFrame:
    # lines -> order totals first, so the customer join runs on orders, not lines
    return (
        delivered(t.orders)
        .join(order_totals(t), "order_id")
        .join(t.customers, "customer_id")
        .groupBy("customer_state")
        .agg(
            count_orders(t).alias("total_orders"),
            as_money(F.sum("order_revenue")).alias("total_revenue"),
        )
    )


def revenue_by_state(t: Tables) -> DataFrame:
    """Delivered orders that have lines, and their revenue, per state."""
    return _state_revenue(t).orderBy(F.desc("total_revenue"), "customer_state")


def revenue_by_category(t: Tables) -> DataFrame:
    """Item price (no freight) per English category, every order status."""
    per_product = t.items.groupBy("product_id").agg(F.sum("price").alias("_price"))
    return (
        total_by_category(per_product, t, "_price", "product_category_name_english")
        .select("product_category_name_english", as_money(F.col("_price")).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "product_category_name_english")
    )


def items_sold_by_category(t: Tables) -> DataFrame:
    """Delivered order lines per English category."""
    per_product = delivered_lines(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        total_by_category(per_product, t, "_n", "category")
        .withColumnRenamed("_n", "total_item_sold")
        .orderBy(F.desc("total_item_sold"), "category")
    )


def top_revenue_month(t: Tables) -> DataFrame:
    """The (year, month) of purchase with the most delivered revenue; ties: earliest."""
    ts = F.col("order_purchase_timestamp")
    return (
        delivered_order_revenue(t)
        .groupBy(calendar_year(ts).alias("year"), calendar_month(ts).alias("month"))
        .agg(as_money(F.sum("order_revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), "year", "month")
        .limit(1)
    )


def top_revenue_state(t: Tables) -> DataFrame:
    """The state with the most delivered revenue; ties: alphabetical."""
    return (
        _state_revenue(t)
        .select("customer_state", "total_revenue")
        .orderBy(F.desc("total_revenue"), "customer_state")
        .limit(1)
    )


def monthly_revenue(t: Tables) -> DataFrame:
    """Delivered revenue per ``yyyy-MM`` of purchase, chronological."""
    return (
        delivered_order_revenue(t)
        .groupBy(year_month(F.col("order_purchase_timestamp")).alias("year_month"))
        .agg(as_money(F.sum("order_revenue")).alias("total_revenue"))
        .orderBy("year_month")
    )


QUERIES = {
    "orders_by_state": orders_by_state,
    "revenue_by_state": revenue_by_state,
    "revenue_by_category": revenue_by_category,
    "items_sold_by_category": items_sold_by_category,
    "top_revenue_month": top_revenue_month,
    "top_revenue_state": top_revenue_state,
    "monthly_revenue": monthly_revenue,
}

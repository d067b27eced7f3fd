"""Section 3, repeat-customer deep dive.

"Repeat" here is definition (c): a person with more than one delivered order.
The set is built once per report (:func:`repeat_persons`) and used as a
semi-join or as a left-join flag; nothing is re-aggregated per reference CTE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions import as_money, line_revenue, percent_2dp, percent_raw
from mercato.operators.segments import (
    CATEGORY,
    PERSON,
    delivered,
    delivered_lines,
    in_english,
    orders_of_persons,
    repeat_lines,
    repeat_orders,
    repeat_persons,
    total_by_category,
    with_raw_category,
)
from mercato.sources import Tables


def repeat_items_by_category(t: Tables) -> DataFrame:
    """Order lines bought by repeat persons, per English category."""
    per_product = repeat_lines(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        total_by_category(per_product, t, "_n")
        .withColumnRenamed("_n", "items_bought_by_repeat_customers")
        .orderBy(F.desc("items_bought_by_repeat_customers"), "product_category")
    )


def repeat_orders_by_seller(t: Tables) -> DataFrame:
    """Distinct delivered orders of repeat persons per seller (known sellers only)."""
    order_sellers = repeat_lines(t).select("order_id", "seller_id").distinct()
    per_seller = order_sellers.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("orders_by_repeat_customers")
    )
    return (
        per_seller.join(t.sellers, "seller_id", "left_semi")
        .select(F.col("seller_id").alias("repeated_seller"), "orders_by_repeat_customers")
        .orderBy(F.desc("orders_by_repeat_customers"), "repeated_seller")
    )


def repeat_customers_by_state(t: Tables) -> DataFrame:
    """Repeat persons per state, over every customer id they own (any orders or none)."""
    # distinct first: a person with very many customer ids has one row a state in the join
    return (
        t.customers.select("customer_state", PERSON)
        .distinct()
        .join(repeat_persons(t), PERSON, "left_semi")
        .groupBy("customer_state")
        .agg(F.count(F.lit(1)).alias("repeat_customers_count"))
        .orderBy(F.desc("repeat_customers_count"), "customer_state")
    )


def _flag_repeat(df: DataFrame, t: Tables) -> DataFrame:
    flag = repeat_persons(t).withColumn("_is_repeat", F.lit(True))
    return df.join(flag, PERSON, "left")


def repeat_pct_by_state(t: Tables) -> DataFrame:
    """Per state: persons with a delivered order there, how many repeat, unrounded %."""
    state_persons = orders_of_persons(t).select("customer_state", PERSON).distinct()
    return (
        _flag_repeat(state_persons, t)
        .groupBy("customer_state")
        .agg(
            F.count(PERSON).alias("total_customers"),
            F.count("_is_repeat").alias("repeat_customers"),
        )
        .withColumn(
            "repeat_customer_percentage",
            percent_raw(F.col("repeat_customers"), F.col("total_customers")),
        )
        .orderBy(F.desc("repeat_customer_percentage"), "customer_state")
    )


def repeat_pct_by_category(t: Tables) -> DataFrame:
    """Per category: persons who bought it (delivered), how many repeat, % to 2 places."""
    person_orders = orders_of_persons(t).select("order_id", PERSON)
    person_products = (
        t.items.select("order_id", "product_id")
        .join(person_orders, "order_id")
        .select(PERSON, "product_id")
        .distinct()
    )
    bought = with_raw_category(person_products, t).select(PERSON, CATEGORY).distinct()
    person_categories = in_english(bought, t, "product_category_name_english").distinct()
    return (
        _flag_repeat(person_categories, t)
        .groupBy("product_category_name_english")
        .agg(
            F.count(PERSON).alias("total_customers"),
            F.count("_is_repeat").alias("repeat_customers"),
        )
        .withColumn(
            "repeat_customer_by_category_percentage",
            percent_2dp(F.col("repeat_customers"), F.col("total_customers")),
        )
        .orderBy(F.desc("repeat_customer_by_category_percentage"), "product_category_name_english")
    )


def repeat_revenue_by_category(t: Tables) -> DataFrame:
    """Delivered revenue (price + freight) from repeat persons per category."""
    per_product = repeat_lines(t, by_rows=True).groupBy("product_id").agg(F.sum(line_revenue()).alias("_rev"))
    return (
        total_by_category(per_product, t, "_rev")
        .select("product_category", as_money(F.col("_rev")).alias("revenue_from_repeat_customers"))
        .orderBy(F.desc("revenue_from_repeat_customers"), "product_category")
    )


def repeat_revenue_by_seller(t: Tables) -> DataFrame:
    """Delivered revenue from repeat persons per seller id on the line (sellers not joined)."""
    return (
        repeat_lines(t, by_rows=True)
        .groupBy("seller_id")
        .agg(as_money(F.sum(line_revenue())).alias("revenue_from_repeat_customers"))
        .orderBy(F.desc("revenue_from_repeat_customers"), "seller_id")
    )


def repeat_orders_by_category(t: Tables) -> DataFrame:
    """Distinct delivered orders of repeat persons per category."""
    order_products = repeat_lines(t).select("order_id", "product_id").distinct()
    order_categories = with_raw_category(order_products, t).select("order_id", CATEGORY).distinct()
    return (
        in_english(order_categories, t)
        .distinct()
        .groupBy("product_category")
        .agg(F.count(F.lit(1)).alias("orders_by_repeat_customers"))
        .orderBy(F.desc("orders_by_repeat_customers"), "product_category")
    )


def _or_zero(total: str) -> Column:
    return F.coalesce(F.round(total, 2), F.lit(0).cast("decimal(18,2)"))


def seller_repeat_dependency(t: Tables) -> DataFrame:
    """Share of each seller's delivered revenue that comes from repeat persons.

    Delivered orders get a repeat flag (a left join, so orders without a known
    customer stay in the total) and meet the lines once; that replaces the
    reference's two aggregates and their outer join. The percentage divides the
    two rounded sums, as the reference does. Lines without a seller are one group
    whose repeat revenue is 0, as NULL never meets NULL in that outer join.
    """
    rev = line_revenue()
    if t.repeated_ids:  # copies of a customer repeat only the second sum
        zero = F.lit(None).cast("decimal(19,2)")
        all_ = delivered_lines(t).select("seller_id", rev.alias("_all"), zero.alias("_own"), F.lit(1).alias("_n"))
        own = repeat_lines(t, by_rows=True).where(F.col("seller_id").isNotNull())
        both = all_.unionByName(own.select("seller_id", zero.alias("_all"), rev.alias("_own"), F.lit(0).alias("_n")))
        sums = both.groupBy("seller_id").agg(F.sum("_all").alias("_all"), F.sum("_own").alias("_own"), F.sum("_n").alias("_n"))
        per_seller = sums.where(F.col("_n") > 0).select("seller_id", F.round("_all", 2).alias("_total"), _or_zero("_own").alias("_repeat"))
    else:
        repeat = repeat_orders(t).distinct().withColumn("_is_repeat", F.lit(True))
        flagged_orders = delivered(t.orders).select("order_id").join(repeat, "order_id", "left")
        own = F.when(F.col("_is_repeat") & F.col("seller_id").isNotNull(), rev)
        sums = (
            t.items.join(flagged_orders, "order_id")
            .groupBy("seller_id")
            .agg(F.sum(rev).alias("_all"), F.sum(own).alias("_own"))
        )
        per_seller = sums.select("seller_id", F.round("_all", 2).alias("_total"), _or_zero("_own").alias("_repeat"))
    return per_seller.select(
        "seller_id",
        F.col("_total").alias("total_revenue"),
        F.col("_repeat").alias("repeat_revenue"),
        percent_2dp(F.col("_repeat"), F.col("_total"), money=True).alias("repeat_revenue_percent"),
    ).orderBy(F.desc("repeat_revenue_percent"), "seller_id")


QUERIES = {
    "repeat_items_by_category": repeat_items_by_category,
    "repeat_orders_by_seller": repeat_orders_by_seller,
    "repeat_customers_by_state": repeat_customers_by_state,
    "repeat_pct_by_state": repeat_pct_by_state,
    "repeat_pct_by_category": repeat_pct_by_category,
    "repeat_revenue_by_category": repeat_revenue_by_category,
    "repeat_revenue_by_seller": repeat_revenue_by_seller,
    "repeat_orders_by_category": repeat_orders_by_category,
    "seller_repeat_dependency": seller_repeat_dependency,
}

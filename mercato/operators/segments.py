"""Shared building blocks: delivered orders, order totals, persons and repeat sets.

All reports are written on these, so the grain of each one is decided here once
(SURVEY §2.4). Two Spark-side rules hold throughout:

* Lines are aggregated to the order (or to the dimension key a report groups by)
  *before* they meet other tables. Catalyst does not push aggregations below
  joins, so this is written by hand; it turns every later join into an
  order-level join and shrinks each shuffle by the lines-per-order factor.
* ``orders.order_id`` and ``customers.customer_id`` are the primary keys of their
  tables, as in the source dataset: then ``COUNT(DISTINCT order_id)`` over a
  customer-order join is a plain row count, which saves the second shuffle Spark plans
  for a distinct aggregate, and a semi-join keeps what a join does. Loading checks
  that (``Tables.repeated_ids``). Where ids do repeat, ids are counted distinct, joins
  keep every copy of a row, as SQL joins do, and an order of a person is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.money import line_revenue
from mercato.schema import DELIVERED
from mercato.sources import Tables

PERSON = "customer_unique_id"
CATEGORY = "product_category_name"


def delivered(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status") == DELIVERED)


def order_totals(t: Tables) -> DataFrame:
    """One row per order that has lines: ``order_revenue`` (sum of price + freight)."""
    if "order_totals" in t.shared:
        return t.shared["order_totals"]
    return t.items.groupBy("order_id").agg(F.sum(line_revenue(True)).alias("order_revenue"))


def orders_of_persons(t: Tables, delivered_only: bool = True) -> DataFrame:
    """Orders with the person who placed them (and the state of that customer id)."""
    if delivered_only and "delivered_person_orders" in t.shared:
        return t.shared["delivered_person_orders"]
    orders = delivered(t.orders) if delivered_only else t.orders
    return orders.join(t.customers, "customer_id")


def order_values(t: Tables, delivered_only: bool = True) -> DataFrame:
    """Orders that have lines, with person and total: ``order_revenue``."""
    if delivered_only and "delivered_person_orders" in t.shared:
        return _one_row_an_order(t.shared["delivered_person_orders"].join(order_totals(t), "order_id"), t)
    orders = delivered(t.orders) if delivered_only else t.orders
    # the order-keyed join first: on order-bucketed tables it needs no shuffle
    return _one_row_an_order(orders.join(order_totals(t), "order_id").join(t.customers, "customer_id"), t)


def _one_row_an_order(values: DataFrame, t: Tables) -> DataFrame:
    """Copies of an order (or of its customer) are one order with all their revenue."""
    if not t.repeated_ids:
        return values
    return values.groupBy(PERSON, "order_id").agg(F.sum("order_revenue").alias("order_revenue"))


def count_orders(t: Tables) -> Column:
    """``COUNT(DISTINCT order_id)`` over rows that are one per order where ids are unique."""
    return F.count_distinct("order_id") if t.repeated_ids else F.count("order_id")


def lines_of(t: Tables, orders: DataFrame) -> DataFrame:
    """The order lines of ``orders`` (``order_id``): a semi-join, so that no order
    columns come along, or with repeated ids a join, which has each line once per copy."""
    return t.items.join(orders, "order_id", "inner" if t.repeated_ids else "left_semi")


def delivered_order_revenue(t: Tables) -> DataFrame:
    """Delivered orders that have lines, with ``order_revenue`` (no customer join)."""
    return delivered(t.orders).join(order_totals(t), "order_id")


def delivered_lines(t: Tables) -> DataFrame:
    """Order lines of delivered orders."""
    return lines_of(t, delivered(t.orders).select("order_id"))


def person_order_counts(t: Tables, delivered_only: bool, with_items: bool) -> DataFrame:
    """``(customer_unique_id, total_orders)`` under one of the four repeat definitions.

    (a) all statuses, any order · (b) all statuses, orders with lines ·
    (c) delivered, any order · (d) delivered, orders with lines.
    """
    orders = orders_of_persons(t, delivered_only)
    if with_items:
        # orders that have lines = the keys of the order totals (shared in suite runs)
        orders = orders.join(order_totals(t).select("order_id"), "order_id", "left_semi")
    return orders.groupBy(PERSON).agg(count_orders(t).alias("total_orders"))


def repeat_persons(t: Tables, delivered_only: bool = True, with_items: bool = False) -> DataFrame:
    """Persons with more than one order under the chosen definition (one row each)."""
    if delivered_only and not with_items and "repeat_persons" in t.shared:
        return t.shared["repeat_persons"]
    counts = person_order_counts(t, delivered_only, with_items)
    return counts.where(F.col("total_orders") > 1).select(PERSON)


def one_time_orders(person_orders: DataFrame) -> DataFrame:
    """``order_id`` of each person whose orders are that one (its repeated rows count once)."""
    ids = person_orders.groupBy(PERSON).agg(
        F.min("order_id").alias("order_id"), F.max("order_id").alias("_last")
    )
    return ids.where(F.col("order_id") == F.col("_last")).select("order_id")


def of_repeat_persons(person_orders: DataFrame) -> DataFrame:
    """The rows of ``person_orders`` whose known person has more than one order in it.

    One-time orders are taken out by their id, so a person with very many orders
    is only a map-side combined group, never a join key.
    """
    known = person_orders.where(F.col(PERSON).isNotNull())
    return known.join(one_time_orders(known), "order_id", "left_anti")


def repeat_orders(t: Tables, by_rows: bool = False) -> DataFrame:
    """Delivered orders placed by repeat persons (definition (c)): ``order_id``.

    ``by_rows`` counts a person's order rows instead of order ids, as three of the
    reports do; with unique ids that is the same.
    """
    if t.repeated_ids:
        rows = orders_of_persons(t).where(F.col(PERSON).isNotNull()).select("order_id", PERSON)
        n = F.count("order_id") if by_rows else F.count_distinct("order_id")
        persons = rows.groupBy(PERSON).agg(n.alias("_n")).where(F.col("_n") > 1).select(PERSON)
        return rows.join(persons, PERSON, "left_semi").select("order_id")
    if "repeat_orders" in t.shared:
        return t.shared["repeat_orders"]
    return of_repeat_persons(orders_of_persons(t).select("order_id", PERSON)).select("order_id")


def repeat_lines(t: Tables, by_rows: bool = False) -> DataFrame:
    """Order lines of delivered orders of repeat persons."""
    return lines_of(t, repeat_orders(t, by_rows))


def with_raw_category(df: DataFrame, t: Tables) -> DataFrame:
    """Attach the product's own ``product_category_name`` (inner join; NULL categories drop out).

    ``df`` should already be aggregated to the product (or order-product) grain so
    this join runs on few rows.
    """
    products = t.products.where(F.col(CATEGORY).isNotNull()).select("product_id", CATEGORY)
    return df.join(products, "product_id")


def in_english(df: DataFrame, t: Tables, alias: str = "product_category") -> DataFrame:
    """Replace ``product_category_name`` by its English name (categories without one drop out).

    There are few categories, so the products are never shuffled on them: ``df``
    should already be reduced to the category (or person- or order-category) grain,
    and be reduced once more by the English name, which several categories may share.
    """
    names = t.translation.select(CATEGORY, F.col("product_category_name_english").alias(alias))
    return df.join(names, CATEGORY).drop(CATEGORY)


def total_by_category(per_product: DataFrame, t: Tables, value: str, alias: str = "product_category") -> DataFrame:
    """``(alias, value)``: the sum of ``value`` over the products of each English category."""
    per_category = with_raw_category(per_product, t).groupBy(CATEGORY).agg(F.sum(value).alias(value))
    return in_english(per_category, t, alias).groupBy(alias).agg(F.sum(value).alias(value))

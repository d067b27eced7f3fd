"""Adapter from the generated star schema (TPC-H-like parquet) to the logical tables.

The derivation is fixed (FIXTURES.md A) and is written a second time, expression
for expression, as the DuckDB prelude in :mod:`mercato.plans.oracle`; change both
together. Everything is a projection of a scan except two things:

* ``order_delivered_customer_date`` is the latest ship date of the order's lines,
  a grouped ``lineitem`` aggregate left-joined on the order key. The aggregate is
  unique on the join key, so when a report does not read the column Catalyst
  removes the join altogether (``EliminateOuterJoin`` on distinct keys) and the
  lines are not scanned for it.
* the category translation is a ``DISTINCT`` over ``part``.

Code-to-label mappings are built so that filters on the label reach the scan
(see :func:`_code_map`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.schema import MONEY
from mercato.sources import Tables, exists

# fixed values of the adapter (FIXTURES.md A)
PERSON_ALIAS_MODULUS = 10  # every 10th customer key is a second id of key + 1
NULL_CATEGORY_MODULUS = 50  # every 50th part has no category
UNTRANSLATED_BRAND = "Brand#13"  # the one category without an English name
STATUS_BY_CODE = (("F", "delivered"), ("O", "shipped"))  # anything else: canceled
OTHER_STATUS = "canceled"
PAYMENT_BY_FLAG = (("A", "credit_card"), ("N", "boleto"))  # anything else: voucher
OTHER_PAYMENT = "voucher"

RAW_TABLES = ("customer", "nation", "orders", "lineitem", "part", "supplier")


def locations(path: str) -> list[str]:
    return [f"{path.rstrip('/')}/{t}.parquet" for t in RAW_TABLES]


def looks_generated(spark: SparkSession, path: str) -> bool:
    return all(exists(spark, at) for at in locations(path))


def _code_map(code: F.Column, pairs, other: str) -> F.Column:
    """``CASE code WHEN raw THEN label ... ELSE other END`` (a NULL code gives ``other``).

    Written as nested two-way CASEs on null-safe equality: then a filter such as
    ``order_status = 'delivered'`` simplifies to ``o_orderstatus <=> 'F'`` and is
    pushed into the parquet scan, which a multi-branch CASE on ``=`` prevents.
    """
    expr = F.lit(other)
    for raw, label in reversed(pairs):
        expr = F.when(code.eqNullSafe(raw), label).otherwise(expr)
    return expr


def _money(c: F.Column) -> F.Column:
    return c.cast(MONEY)


def load(spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None) -> Tables:
    """The logical tables of the files under ``path``. Schemas in ``schemas`` spare
    their inference, which reads footers; those not in it are put there."""
    schemas = {} if schemas is None else schemas

    def raw(name: str) -> DataFrame:
        at = f"{path.rstrip('/')}/{name}.parquet"
        found = spark.read.schema(schemas[name]).parquet(at) if name in schemas else spark.read.parquet(at)
        schemas[name] = found.schema
        return found

    customer, nation = raw("customer"), raw("nation")
    orders, lineitem = raw("orders"), raw("lineitem")
    part, supplier = raw("part"), raw("supplier")

    key = F.col("c_custkey")
    customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("customer_id"),
        F.when(key % PERSON_ALIAS_MODULUS == 0, key + 1).otherwise(key).alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"),
    )

    last_ship = lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    is_final = F.col("o_orderstatus") == STATUS_BY_CODE[0][0]
    orders_t = orders.join(last_ship, orders.o_orderkey == last_ship.l_orderkey, "left").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _code_map(F.col("o_orderstatus"), STATUS_BY_CODE, OTHER_STATUS).alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(is_final, F.col("last_ship")).alias("order_delivered_customer_date"),
    )

    price = _money(F.col("l_extendedprice"))
    items = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        _money(F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2)).alias("freight_value"),
    )

    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % NULL_CATEGORY_MODULUS == 0, F.lit(None))
        .otherwise(F.col("p_brand"))
        .alias("product_category_name"),
    )

    translation = (
        part.where(F.col("p_brand") != UNTRANSLATED_BRAND)
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias(
                "product_category_name_english"
            ),
        )
        .distinct()
    )

    sellers = supplier.select(F.col("s_suppkey").alias("seller_id"))

    payments = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        _code_map(F.col("l_returnflag"), PAYMENT_BY_FLAG, OTHER_PAYMENT).alias("payment_type"),
        price.alias("payment_value"),
    )

    return Tables(customers, orders_t, items, products, translation, sellers, payments)

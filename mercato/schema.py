"""Explicit schemas of the seven logical marketplace tables.

Only the columns the reports read are declared. Ids are opaque: the adapter
over the generated test data yields ``bigint`` ids, the public dataset and the
micro fixture use strings; :func:`logical_schemas` builds either.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# fixed values: order status that the reports filter on, and the statuses the
# test-data adapter produces
DELIVERED = "delivered"
ADAPTER_STATUSES = ("delivered", "shipped", "canceled")

TABLE_NAMES = (
    "customers",
    "orders",
    "items",
    "products",
    "translation",
    "sellers",
    "payments",
)


def logical_schemas(id_type: T.DataType = T.StringType()) -> dict[str, T.StructType]:
    def f(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
        return T.StructField(name, dtype, nullable)

    return {
        "customers": T.StructType(
            [
                f("customer_id", id_type),
                f("customer_unique_id", id_type),
                f("customer_state", T.StringType()),
            ]
        ),
        "orders": T.StructType(
            [
                f("order_id", id_type),
                f("customer_id", id_type),
                f("order_status", T.StringType()),
                f("order_purchase_timestamp", T.TimestampNTZType()),
                f("order_delivered_customer_date", T.TimestampNTZType(), True),
            ]
        ),
        "items": T.StructType(
            [
                f("order_id", id_type),
                f("product_id", id_type),
                f("seller_id", id_type),
                f("price", MONEY, True),
                f("freight_value", MONEY, True),
            ]
        ),
        "products": T.StructType(
            [f("product_id", id_type), f("product_category_name", T.StringType(), True)]
        ),
        "translation": T.StructType(
            [
                f("product_category_name", T.StringType()),
                f("product_category_name_english", T.StringType()),
            ]
        ),
        "sellers": T.StructType([f("seller_id", id_type)]),
        "payments": T.StructType(
            [
                f("order_id", id_type),
                f("payment_type", T.StringType()),
                f("payment_value", MONEY, True),
            ]
        ),
    }

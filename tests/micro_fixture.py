"""The hand-written micro fixture (FIXTURES.md B) as a :class:`Tables` bundle.

Nine customers, nine orders, ten lines, string ids. Each grain trap of
SURVEY §2.4 changes at least one answer here.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from mercato.schema import logical_schemas
from mercato.sources import Tables


def ts(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


CUSTOMERS = [
    ("c1", "P1", "SP"),
    ("c2", "P1", "RJ"),
    ("c3", "P2", "SP"),
    ("c4", "P3", "RJ"),
    ("c5", "P4", "SP"),
    ("c6", "P4", "SP"),
    ("c7", "P5", "AC"),
    ("c8", "P5", "AC"),
    ("c9", "P1", "AC"),
]

ORDERS = [
    ("o1", "c1", "delivered", "2017-11-24 10:00", "2017-12-01 23:59"),
    ("o2", "c2", "delivered", "2018-01-05 09:00", "2018-01-10 00:01"),
    ("o3", "c3", "delivered", "2017-11-24 22:00", "2017-11-30 12:00"),
    ("o4", "c4", "delivered", "2018-01-06 08:00", None),
    ("o5", "c5", "delivered", "2018-02-01 00:00", "2018-02-08 12:00"),
    ("o6", "c6", "canceled", "2018-02-10 00:00", None),
    ("o7", "c7", "delivered", "2018-02-12 00:00", "2018-02-20 12:00"),
    ("o8", "c8", "delivered", "2018-03-01 00:00", "2018-03-05 12:00"),
    ("o9", "c1", "shipped", "2018-04-01 00:00", None),
]

ITEMS = [
    ("o1", "pA", "s1", "10", "1"),
    ("o1", "pA", "s1", "10", "1"),
    ("o1", "pB", "s2", "20", "2.01"),
    ("o2", "pA", "s1", "10", "1"),
    ("o2", "pC", "s2", "30", "0"),
    ("o3", "pB", "s4", "20", "2"),
    ("o4", "pD", "s1", "5", "0.50"),
    ("o5", "pA", "s1", "10", "1"),
    ("o6", "pB", "s2", "20", "2"),
    ("o8", "pE", "s3", "22", "0"),
]

PRODUCTS = [("pA", "cama"), ("pB", "beleza"), ("pC", None), ("pD", "pc_gamer"), ("pE", "beleza")]
TRANSLATION = [("cama", "bed_bath_table"), ("beleza", "health_beauty")]
SELLERS = [("s1",), ("s2",), ("s4",)]
PAYMENTS = [
    ("o1", "credit_card", "40"),
    ("o1", "voucher", "2"),
    ("o1", "voucher", "2.01"),
    ("o2", "credit_card", "41"),
    ("o3", "boleto", "22"),
    ("o4", "credit_card", "5.50"),
    ("o5", "credit_card", "11"),
    ("o6", "credit_card", "22"),
    ("o8", "boleto", "22"),
]


def micro_tables(spark: SparkSession) -> Tables:
    s = logical_schemas()
    money = lambda v: Decimal(v).quantize(Decimal("0.01"))
    frames = {
        "customers": spark.createDataFrame(CUSTOMERS, s["customers"]),
        "orders": spark.createDataFrame(
            [(o, c, st, ts(p), ts(d)) for o, c, st, p, d in ORDERS], s["orders"]
        ),
        "items": spark.createDataFrame(
            [(o, p, se, money(pr), money(fr)) for o, p, se, pr, fr in ITEMS], s["items"]
        ),
        "products": spark.createDataFrame(PRODUCTS, s["products"]),
        "translation": spark.createDataFrame(TRANSLATION, s["translation"]),
        "sellers": spark.createDataFrame(SELLERS, s["sellers"]),
        "payments": spark.createDataFrame(
            [(o, t, money(v)) for o, t, v in PAYMENTS], s["payments"]
        ),
    }
    return Tables(**frames)

"""Hand-derived answers on the micro fixture (FIXTURES.md B), in output order."""

from __future__ import annotations

import datetime as dt
import pytest

from mercato.functions.money import as_doubles
from mercato.plans import REPORTS


def T(text):
    return dt.datetime.fromisoformat(text)


D = dt.date

GOLDEN = {
    "orders_by_state": [("SP", 3), ("AC", 2), ("RJ", 2)],
    "revenue_by_state": [("SP", 3, 77.01), ("RJ", 2, 46.5), ("AC", 1, 22.0)],
    "revenue_by_category": [("health_beauty", 82.0), ("bed_bath_table", 40.0)],
    "items_sold_by_category": [("bed_bath_table", 4), ("health_beauty", 3)],
    "top_revenue_month": [(2017, 11, 66.01)],
    "top_revenue_state": [("SP", 77.01)],
    "monthly_revenue": [("2017-11", 66.01), ("2018-01", 46.5), ("2018-02", 11.0), ("2018-03", 22.0)],
    "customer_spend": [("P1", 85.01), ("P2", 22.0), ("P5", 22.0), ("P4", 11.0), ("P3", 5.5)],
    "customer_type": [
        ("P1", 3, "Repeat customer"),
        ("P4", 2, "Repeat customer"),
        ("P5", 2, "Repeat customer"),
        ("P2", 1, "One-time buyer"),
        ("P3", 1, "One-time buyer"),
    ],
    "repeat_customer_pct": [(60.0,)],
    "avg_orders_repeat": [(2,)],
    "avg_revenue_repeat": [(59.01,)],
    "avg_revenue_one_time": [(16.5,)],
    "customer_revenue_rank": [
        ("P1", 85.01, 1),
        ("P2", 22.0, 2),
        ("P5", 22.0, 2),
        ("P4", 11.0, 3),
        ("P3", 5.5, 4),
    ],
    "customer_first_last_order": [
        ("P1", T("2017-11-24 10:00"), T("2018-01-05 09:00")),
        ("P2", T("2017-11-24 22:00"), T("2017-11-24 22:00")),
        ("P3", T("2018-01-06 08:00"), T("2018-01-06 08:00")),
        ("P4", T("2018-02-01 00:00"), T("2018-02-01 00:00")),
        ("P5", T("2018-02-12 00:00"), T("2018-03-01 00:00")),
    ],
    "delivery_gap_days": [
        ("P1", T("2017-12-01 23:59"), T("2018-01-10 00:01"), 40),
        ("P5", T("2018-02-20 12:00"), T("2018-03-05 12:00"), 13),
    ],
    "customer_lifetime_days": [
        ("P1", T("2017-12-01 23:59"), T("2018-01-10 00:01"), 40),
        ("P5", T("2018-02-20 12:00"), T("2018-03-05 12:00"), 13),
        ("P2", T("2017-11-30 12:00"), T("2017-11-30 12:00"), 0),
        ("P4", T("2018-02-08 12:00"), T("2018-02-08 12:00"), 0),
    ],
    "order_frequency_buckets": [("1 Order", 3, 60.0), ("2 Orders", 2, 40.0)],
    "repeat_items_by_category": [("bed_bath_table", 3), ("health_beauty", 2)],
    "repeat_orders_by_seller": [("s1", 2), ("s2", 2)],
    "repeat_customers_by_state": [("AC", 2), ("RJ", 1), ("SP", 1)],
    "repeat_pct_by_state": [("AC", 1, 1, 100.0), ("RJ", 2, 1, 50.0), ("SP", 3, 1, 100.0 / 3)],
    "repeat_pct_by_category": [("health_beauty", 3, 2, 66.67), ("bed_bath_table", 2, 1, 50.0)],
    "repeat_revenue_by_category": [("health_beauty", 44.01), ("bed_bath_table", 33.0)],
    "repeat_revenue_by_seller": [("s2", 52.01), ("s1", 33.0), ("s3", 22.0)],
    "repeat_orders_by_category": [("bed_bath_table", 2), ("health_beauty", 2)],
    "seller_repeat_dependency": [
        ("s2", 52.01, 52.01, 100.0),
        ("s3", 22.0, 22.0, 100.0),
        ("s1", 49.5, 33.0, 66.67),
        ("s4", 22.0, 0.0, 0.0),
    ],
    "repeat_aov_by_seller": [("s1", 43.01), ("s2", 42.51)],
    "repeat_aov_by_category": [("health_beauty", 44.01), ("bed_bath_table", 42.51)],
    "cumulative_revenue": [
        (D(2017, 11, 24), 66.01, 66.01),
        (D(2018, 1, 5), 41.0, 107.01),
        (D(2018, 1, 6), 5.5, 112.51),
        (D(2018, 2, 1), 11.0, 123.51),
        (D(2018, 3, 1), 22.0, 145.51),
    ],
    "revenue_by_payment_type": [
        ("credit_card", 97.5, 4, 67.01),
        ("boleto", 44.0, 2, 30.24),
        ("voucher", 4.01, 1, 2.76),
    ],
    "revenue_by_weekday": [("Friday", 107.01), ("Thursday", 33.0), ("Saturday", 5.5)],
    "products_bought_together": [("pA", "pB", 2), ("pA", "pC", 1)],
    "top_revenue_category": [("health_beauty", 66.01)],
    "top_product_per_category": [("pA", "bed_bath_table", 40.0), ("pB", "health_beauty", 40.0)],
}

# reports without an ORDER BY in the reference: compare as sets
UNORDERED = {"aov_by_segment": {("Repeat Customer", 42.51), ("One-Time Customer", 15.13)}}


def test_every_report_has_a_golden():
    assert set(GOLDEN) | set(UNORDERED) == set(REPORTS)


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_in_order(micro, name):
    rows = [tuple(r) for r in as_doubles(REPORTS[name](micro)).collect()]
    assert rows == GOLDEN[name]


@pytest.mark.parametrize("name", sorted(UNORDERED))
def test_golden_unordered(micro, name):
    rows = {tuple(r) for r in as_doubles(REPORTS[name](micro)).collect()}
    assert rows == UNORDERED[name]


@pytest.mark.parametrize(
    "delivered_only, with_items, expected",
    [
        (False, False, {"P1", "P4", "P5"}),  # (a) every status, any order
        (False, True, {"P1", "P4"}),  # (b) every status, orders with lines
        (True, False, {"P1", "P5"}),  # (c) delivered, any order
        (True, True, {"P1"}),  # (d) delivered, orders with lines
    ],
)
def test_four_repeat_definitions(micro, delivered_only, with_items, expected):
    from mercato.operators.segments import repeat_persons

    got = {r[0] for r in repeat_persons(micro, delivered_only, with_items).collect()}
    assert got == expected


def test_exact_mean_option_for_repeat_order_count(micro):
    from mercato.plans.customers import avg_orders_repeat

    (row,) = avg_orders_repeat(micro, truncate=False).collect()
    assert row[0] == pytest.approx(7 / 3)

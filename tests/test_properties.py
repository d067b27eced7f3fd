"""Cross-report properties on the generated sf0.01 data."""

from __future__ import annotations

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from mercato.functions.money import as_doubles
from mercato.plans import REPORTS
from mercato.sources import load_tables


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, SF01)


def rows(t, name):
    return as_doubles(REPORTS[name](t)).collect()


def test_frequency_shares_sum_to_100_and_persons(t):
    got = rows(t, "order_frequency_buckets")
    assert abs(float(sum(r.percentage for r in got)) - 100.0) <= 0.02 * len(got)
    persons = len(rows(t, "customer_first_last_order"))
    assert sum(r.number_of_customers for r in got) == persons
    assert [r.order_frequency_group for r in got] == sorted(r.order_frequency_group for r in got)


def test_payment_shares_sum_to_100(t):
    got = rows(t, "revenue_by_payment_type")
    assert abs(sum(r.revenue_share_percent for r in got) - 100.0) <= 0.01 * len(got)
    assert [r.total_revenue for r in got] == sorted((r.total_revenue for r in got), reverse=True)


def test_last_cumulative_equals_total(t):
    cum = rows(t, "cumulative_revenue")
    monthly = rows(t, "monthly_revenue")
    assert [r.order_date for r in cum] == sorted(r.order_date for r in cum)
    assert cum[-1].cumulative_revenue == pytest.approx(sum(r.total_revenue for r in monthly), abs=0.005)
    running = 0.0
    for r in cum:
        running += r.revenue
        assert r.cumulative_revenue == pytest.approx(running, abs=0.01)


def test_repeat_revenue_never_exceeds_total(t):
    for r in rows(t, "seller_repeat_dependency"):
        assert 0.0 <= r.repeat_revenue <= r.total_revenue
        assert 0.0 <= r.repeat_revenue_percent <= 100.0


def test_dense_rank_is_dense_and_ordered(t):
    got = rows(t, "customer_revenue_rank")
    ranks = [r.revenue_rank for r in got]
    assert ranks == sorted(ranks)
    assert ranks[0] == 1 and set(ranks) == set(range(1, max(ranks) + 1))
    assert max(ranks) == len({r.lifetime_revenue for r in got})
    by_rank = {}
    for r in got:
        by_rank.setdefault(r.revenue_rank, set()).add(r.lifetime_revenue)
    assert all(len(v) == 1 for v in by_rank.values())


def test_persons_in_two_states_count_in_each(t):
    per_state = sum(r.repeat_customers_count for r in rows(t, "repeat_customers_by_state"))
    repeaters = (
        REPORTS["order_frequency_buckets"](t)
        .where(F.col("order_frequency_group") != "1 Order")
        .agg(F.sum("number_of_customers"))
        .collect()[0][0]
    )
    assert per_state > repeaters  # 143 persons own customer ids in two states


def test_gap_rows_are_deliveries_minus_first(t):
    gaps = rows(t, "delivery_gap_days")
    life = rows(t, "customer_lifetime_days")
    deliveries = (
        t.orders.where("order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL")
        .count()
    )
    assert len(gaps) == deliveries - len(life)
    assert [r.gap_days for r in gaps] == sorted((r.gap_days for r in gaps), reverse=True)
    # per person, the gaps add up to the lifetime
    total_gap = {}
    for r in gaps:
        total_gap[r.customer_unique_id] = total_gap.get(r.customer_unique_id, 0) + r.gap_days
    for r in life:
        assert total_gap.get(r.customer_unique_id, 0) == r.lifetime_days


def test_top_rows_agree_with_full_reports(t):
    state = rows(t, "top_revenue_state")[0]
    full = rows(t, "revenue_by_state")[0]
    assert (state.customer_state, state.total_revenue) == (full.customer_state, full.total_revenue)
    month = rows(t, "top_revenue_month")[0]
    best = max(rows(t, "monthly_revenue"), key=lambda r: r.total_revenue)
    assert f"{month.year:04d}-{month.month:02d}" == best.year_month

"""Bucketed layout: same answers, and no shuffle of the lines on the order key."""

from __future__ import annotations

import re

import pytest
from conftest import SF001

from mercato.plans import REPORTS
from mercato.sources import load_tables
from mercato.sources.bucketed import load_bucketed, write_bucketed

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def tables(spark):
    plain = load_tables(spark, SF001)
    write_bucketed(plain, "mercato_bucketed_test", 8, mode="overwrite")
    return plain, load_bucketed(spark, "mercato_bucketed_test")


@pytest.fixture
def no_broadcast(spark):
    previous = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in previous.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_bucketed_tables_give_the_same_answers(tables, name):
    plain, bucketed = tables
    a = sorted((tuple(r) for r in REPORTS[name](plain).collect()), key=repr)
    b = sorted((tuple(r) for r in REPORTS[name](bucketed).collect()), key=repr)
    assert a == b


@pytest.mark.parametrize(
    "name", ["revenue_by_state", "customer_spend", "revenue_by_payment_type", "monthly_revenue"]
)
def test_no_order_key_shuffle_on_bucketed_tables(tables, no_broadcast, name):
    _, bucketed = tables
    df = REPORTS[name](bucketed)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((order_id|l_orderkey)", plan), name

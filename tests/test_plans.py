"""Physical-plan properties that the scale design relies on."""

from __future__ import annotations

import re

import pytest
from conftest import SF001

from mercato.plans import REPORTS, run

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def executed(spark, name: str) -> str:
    df = run(spark, SF001, name)
    df.collect()  # AQE: the final plan exists only after execution
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_python_in_any_plan(spark, name):
    plan = executed(spark, name)
    assert not any(node in plan for node in PYTHON_NODES), name


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = executed(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_dense_rank_is_partitioned_by_block(spark):
    plan = executed(spark, "customer_revenue_rank")
    ranks = [line for line in plan.split("\n") if "dense_rank(" in line]
    assert ranks and all("windowspecdefinition(_block" in line for line in ranks)


def test_top_product_uses_partial_group_limit(spark):
    plan = executed(spark, "top_product_per_category")
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_lineitem_scan_is_pruned_and_delivery_join_removed(spark):
    plan = executed(spark, "revenue_by_state")
    schemas = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    line_scans = [s for s in schemas if "l_orderkey" in s]
    assert line_scans
    for cols in line_scans:
        assert set(re.sub(r"#\d+L?", "", cols).split(",")) == {
            "l_orderkey",
            "l_extendedprice",
            "l_tax",
        }
    # the report does not read the delivered date: the adapter's ship-date aggregate is gone
    assert "l_shipdate" not in plan


def test_status_filter_is_pushed_into_the_orders_scan(spark):
    plan = executed(spark, "revenue_by_state")
    order_scans = [line for line in plan.split("\n") if "FileScan parquet [o_orderkey" in line]
    assert order_scans
    assert all("PushedFilters: [" in line and "EqualNullSafe(o_orderstatus,F)" in line for line in order_scans)


@pytest.mark.parametrize(
    "name",
    [
        "repeat_items_by_category",
        "repeat_orders_by_seller",
        "repeat_revenue_by_category",
        "repeat_revenue_by_seller",
        "repeat_orders_by_category",
        "seller_repeat_dependency",
        "repeat_aov_by_seller",
        "repeat_aov_by_category",
    ],
)
def test_orders_and_lines_are_never_joined_on_the_person(micro, name):
    plan = REPORTS[name](micro)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if re.search(r"\bJoin (Inner|Left)", line)]
    assert joins and not any("customer_unique_id" in line for line in joins)


@pytest.mark.parametrize(
    "name",
    [
        "revenue_by_category",
        "items_sold_by_category",
        "top_revenue_category",
        "top_product_per_category",
        "repeat_items_by_category",
        "repeat_pct_by_category",
        "repeat_revenue_by_category",
        "repeat_orders_by_category",
        "repeat_aov_by_category",
    ],
)
def test_category_names_join_only_reduced_rows(micro, name):
    """The translation joins an aggregate, a distinct or a group limit, never the products."""
    plan = REPORTS[name](micro)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.split("\n")]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan.split("\n")]
    at = [i for i, line in enumerate(lines) if re.match(r"Join Inner, \(product_category_name#", line)]
    assert len(at) == 1
    below = next(line for line, d in zip(lines[at[0] + 1 :], depth[at[0] + 1 :]) if not line.startswith(("Project", "Filter")))
    assert below.startswith(("Aggregate", "Window", "WindowGroupLimit")), below

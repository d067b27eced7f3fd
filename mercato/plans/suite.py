"""Run many reports over the same tables, building shared intermediates once.

Run one at a time, each report recomputes its own inputs: fourteen of them
aggregate every order line to its order, nine rebuild the repeat-person set. For a
run of the whole catalogue (what the reference's scripts do) those order- and
person-level intermediates are built once, written with ``checkpoint()`` into
the shared ``spark.checkpoint.dir``, and every report reads them:

* ``order_totals``            one row per order with lines: revenue
* ``delivered_person_orders`` delivered orders with the person and state of the buyer
* ``repeat_persons``          persons with more than one delivered order
* ``repeat_orders``           delivered orders of those persons

Each is far smaller than the order lines, so writing it once costs less than a
second scan-and-shuffle of the lines, and the checkpoint cuts lineage: a lost
executor re-reads the shared files instead of recomputing the line aggregate.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from mercato.operators.segments import (
    order_totals,
    orders_of_persons,
    repeat_orders,
    repeat_persons,
)
from mercato.plans import REPORTS
from mercato.session import checkpoint_dir
from mercato.sources import Tables, load_tables


def with_shared_intermediates(t: Tables) -> Tables:
    spark = t.orders.sparkSession
    checkpoint_dir(spark)
    shared: dict[str, DataFrame] = {}

    def keep(name: str, build: Callable[[Tables], DataFrame]) -> None:
        # each step may read the intermediates built before it
        shared[name] = build(dataclasses.replace(t, shared=dict(shared))).checkpoint(eager=True)

    keep("order_totals", order_totals)
    keep("delivered_person_orders", orders_of_persons)
    keep("repeat_persons", repeat_persons)
    keep("repeat_orders", repeat_orders)
    return dataclasses.replace(t, shared=shared)


def run_suite(
    spark: SparkSession,
    path: str,
    names: Iterable[str] | None = None,
    sink: Callable[[str, DataFrame], None] | None = None,
) -> dict[str, float]:
    """Load the tables of ``path`` and run :func:`run_tables` on them."""
    return run_tables(load_tables(spark, path), names, sink)


def run_tables(
    t: Tables,
    names: Iterable[str] | None = None,
    sink: Callable[[str, DataFrame], None] | None = None,
) -> dict[str, float]:
    """Build the shared intermediates, then every report; returns seconds per step.

    ``sink(name, df)`` consumes each report (default: execute into the ``noop``
    sink); pass a writer to keep the results.
    """
    sink = sink or (lambda _name, df: df.write.format("noop").mode("overwrite").save())
    timings: dict[str, float] = {}
    t0 = time.perf_counter()
    tables = with_shared_intermediates(t)
    timings["_shared"] = time.perf_counter() - t0
    for name in names or REPORTS:
        t1 = time.perf_counter()
        sink(name, REPORTS[name](tables))
        timings[name] = time.perf_counter() - t1
    return timings

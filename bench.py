"""Benchmark: every registered report at one scale factor, one JSON line out.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] threads (default 8)
    BENCH_RUNS     timed runs per report after one warm-up (default 3)
    BENCH_ONLY     optional comma-separated report names

Each run builds the report from the files (adapter included) and executes the
whole plan into Spark's ``noop`` sink, so nothing is collected to the driver
and the time is the cluster-side work. Per report the median run is kept; the
headline value is the sum of the medians (every report standalone, as
``mercato.plans.run`` runs it: order- and person-level tables that an earlier report of
the session wrote for the same files are read again, see ``mercato.sources.reuse``).

``plain_sec`` is the whole catalogue (one pass) with nothing kept: every report from the
files alone. Skip it with BENCH_PLAIN=0.

``suite_sec`` is one further measurement: the whole catalogue run as a suite
(``mercato.plans.suite``), with the order totals and repeat sets built once and
checkpointed, then every report reading them. Skip it with BENCH_SUITE=0.

``bucketed_sec`` is the whole catalogue (one pass) over the same tables saved
once with ``mercato.sources.bucketed`` (bucketed on their join keys, into a fresh
scratch warehouse); ``bucketed_write_sec`` is that one-time write. Skip with
BENCH_BUCKETED=0.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]

    from mercato.plans import REPORTS, run
    from mercato.session import build_session

    warehouse = tempfile.mkdtemp(prefix="run-bench-warehouse-", dir="/tmp")
    spark = build_session(
        f"local[{cpus}]",
        shuffle_partitions=cpus,
        app_name="mercato-bench",
        extra={"spark.sql.warehouse.dir": warehouse},
    )
    names = only or list(REPORTS)

    def once(name: str) -> float:
        t0 = time.perf_counter()
        run(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timings: dict[str, float] = {}
    for name in names:
        once(name)  # warm-up: JIT, file listing, metadata caches
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)

    plain_sec = None
    if os.environ.get("BENCH_PLAIN", "1") != "0" and not only:
        from mercato.sources import load_tables

        t0 = time.perf_counter()
        for name in REPORTS:
            REPORTS[name](load_tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        plain_sec = round(time.perf_counter() - t0, 3)

    suite_sec = None
    if os.environ.get("BENCH_SUITE", "1") != "0" and not only:
        from mercato.plans.suite import run_suite

        t0 = time.perf_counter()
        run_suite(spark, sf_dir)
        suite_sec = round(time.perf_counter() - t0, 3)

    bucketed_sec = bucketed_write_sec = None
    if os.environ.get("BENCH_BUCKETED", "1") != "0" and not only:
        from mercato.sources import load_tables
        from mercato.sources.bucketed import load_bucketed, write_bucketed

        t0 = time.perf_counter()
        write_bucketed(load_tables(spark, sf_dir), "mercato_bench", cpus)
        bucketed_write_sec = round(time.perf_counter() - t0, 3)
        tables = load_bucketed(spark, "mercato_bench")
        t0 = time.perf_counter()
        for name in REPORTS:
            REPORTS[name](tables).write.format("noop").mode("overwrite").save()
        bucketed_sec = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": f"sum_of_median_seconds_{len(names)}_reports",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "runs": runs,
                "load": [round(x, 1) for x in os.getloadavg()],
                "plain_sec": plain_sec,
                "suite_sec": suite_sec,
                "bucketed_sec": bucketed_sec,
                "bucketed_write_sec": bucketed_write_sec,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

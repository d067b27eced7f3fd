"""bench.py prints exactly one JSON line with the fields the driver records."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from conftest import ROOT, SF001

from mercato.plans import REPORTS


def test_bench_prints_one_json_line():
    env = dict(
        os.environ,
        BENCH_SF_DIR=SF001,
        BENCH_CPUS="2",
        BENCH_RUNS="1",
        BENCH_ONLY="orders_by_state,revenue_by_state",
    )
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env,
        capture_output=True,
        text=True,
        timeout=600,
        check=True,
    ).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(result)
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == {"orders_by_state", "revenue_by_state"}
    assert result["value"] > 0


DRIVER_LIKE = r"""
import importlib.util, json, sys
spec = importlib.util.spec_from_file_location("entry_under_test", sys.argv[1])
mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(mod)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = mod.entry(spark)
print(json.dumps({"rows": df.count(), "columns": df.columns,
                  "queries": sorted(mod.queries()), "oracle": sorted(mod.oracle_sql())}))
"""


def test_entry_points_load_by_path_from_another_directory(tmp_path):
    out = subprocess.run(
        [sys.executable, "-c", DRIVER_LIKE, os.path.join(ROOT, "__spark_entry__.py")],
        cwd=str(tmp_path),
        capture_output=True,
        text=True,
        timeout=600,
        check=True,
    ).stdout
    result = json.loads(out.strip().splitlines()[-1])
    assert result["rows"] > 0
    assert result["columns"] == ["customer_state", "total_orders", "total_revenue"]
    assert set(REPORTS) <= set(result["oracle"]) <= set(result["queries"])

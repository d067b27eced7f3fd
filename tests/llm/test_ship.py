"""A driver in a folder of its own: the workers get the package from it."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {ROOT + "/__spark_entry__.py"!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op9_simhash", "op10_html_text"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
import corpus_pipeline
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
print("packing", corpus_pipeline.STAGES[-1][1](spark, docs, None).count() > 0)
"""


def test_operators_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    found = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "packing")))
    assert int(found["op9_simhash"]) >= 200 and int(found["op10_html_text"]) > 0 and found["packing"] == "True"

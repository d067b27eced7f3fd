"""Write PLANS.md: the physical shape of every report as Spark plans it for large inputs.

Statistics are those of the sf0.1 files, but AQE is off and the static broadcast
threshold is 32 KB, so only the tiny nation and supplier files are broadcast -- the
shape a large cluster run starts from before AQE re-plans with measured sizes. Counts
are of physical operators in the whole plan of the report, from the files alone (no
kept tables); "reused" shuffles are read again and not counted among the others.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mercato.plans import REPORTS  # noqa: E402
from mercato.session import build_session  # noqa: E402
from mercato.sources import load_tables  # noqa: E402


def describe(plan: str) -> dict[str, str]:
    def n(pattern: str) -> int:
        return len(re.findall(pattern, plan))

    windows = set()
    for spec in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan):
        keys = [
            re.sub(r"#\d+L?", "", k.strip())
            for k in spec.split(", ")
            if k.strip() and " ASC " not in k + " " and " DESC " not in k + " "
        ]
        windows.add("(" + ", ".join(keys) + ")" if keys else "none: bounded input")
    windows = sorted(windows)
    scans = sorted(
        {
            re.sub(r"#\d+L?", "", m)
            for m in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
        }
    )
    return {
        "hash shuffles": str(
            n(r"Exchange hashpartitioning") - n(r"ReusedExchange [^\n]*Exchange hashpartitioning")
        ),
        "reused": str(n(r"ReusedExchange")),
        "range shuffles": str(n(r"Exchange rangepartitioning")),
        "single-partition": str(n(r"Exchange SinglePartition")),
        "broadcasts": str(n(r"BroadcastExchange")),
        "sort-merge joins": str(n(r"SortMergeJoin")),
        "broadcast joins": str(n(r"BroadcastHashJoin")),
        "windows (first key)": ", ".join(windows) or "-",
        "scans": "; ".join(scans),
    }


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = build_session(
        "local[8]",
        8,
        extra={"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "32k"},
    )
    cols = ["hash shuffles", "reused", "range shuffles", "single-partition", "broadcasts",
            "sort-merge joins", "broadcast joins", "windows (first key)"]
    tables = load_tables(spark, sf_dir)
    print("# PLANS\n")
    print(__doc__.split("\n\n")[1].replace("\n", " ").strip() + "\n")
    print("Regenerate with `python tools/plan_report.py > PLANS.md`.\n")
    print("| report | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    scans = {}
    for name in REPORTS:
        plan = REPORTS[name](tables)._jdf.queryExecution().executedPlan().toString()
        d = describe(plan)
        scans[name] = d["scans"]
        print(f"| `{name}` | " + " | ".join(d[c] for c in cols) + " |")
    print("\nSingle-partition exchanges appear only above bounded inputs: the root of a")
    print("tree of block sums (one row for each 2^32 or 2^48 block numbers in use), partial sums")
    print("of a total (one row per task), and `TOP 1` results. Windows are keyed by block, parent")
    print("block, (person, day), person over one row per active day, or category after a partial")
    print("group limit.\n")
    print("## Columns read per report\n")
    for name, s in scans.items():
        print(f"* `{name}`: {s}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

"""Command line: list the reports, or run one and show it or write it out.

    python -m mercato list
    python -m mercato run revenue_by_state --data /root/testdata/sf0.1 --show 20
    python -m mercato run customer_spend --data DIR --out OUT --format parquet
    python -m mercato suite --data DIR --out OUT     # every report, OUT/<report>/
    python -m mercato check --data DIR               # rows that break a rule, per rule
    python -m mercato layout --data DIR --database DB --buckets 2048
    python -m mercato suite --database DB --out OUT  # read the bucketed tables
    python -m mercato run customer_spend --data DIR --names orders=ORDERS items=LINES
    python -m mercato run customer_spend --database DB --names orders=ORDERS

``--names`` maps logical tables to file stems under ``--data`` or to tables of
``--database``, which are then cast to the schema like files; without it
``--database`` holds tables written by 'layout'.

``--master`` defaults to the session already configured by ``spark-submit``
(or ``local[*]`` when run directly). Writing uses the ``errorifexists`` mode
unless ``--mode`` says otherwise.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mercato")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="list the report names")
    run_p = sub.add_parser("run", help="run one report")
    run_p.add_argument("report")
    run_p.add_argument("--data", help="folder with the input tables")
    run_p.add_argument("--database", help="catalog database written by 'layout'")
    run_p.add_argument("--show", type=int, default=20, help="rows to print when not writing")
    run_p.add_argument("--out", help="write the result to this path instead of printing")
    run_p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run_p.add_argument("--mode", default="errorifexists")
    run_p.add_argument("--master", default=None)
    suite_p = sub.add_parser("suite", help="run every report, sharing intermediates")
    suite_p.add_argument("--data")
    suite_p.add_argument("--database", help="catalog database written by 'layout'")
    suite_p.add_argument("--out", required=True, help="folder; one sub-folder per report")
    suite_p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    suite_p.add_argument("--mode", default="errorifexists")
    suite_p.add_argument("--master", default=None)
    layout_p = sub.add_parser("layout", help="save the tables bucketed on their join keys")
    layout_p.add_argument("--data", required=True)
    layout_p.add_argument("--database", required=True)
    layout_p.add_argument("--buckets", type=int, required=True)
    layout_p.add_argument("--mode", default="errorifexists")
    layout_p.add_argument("--master", default=None)
    check_p = sub.add_parser("check", help="count the rows that break what the tables promise")
    check_p.add_argument("--data")
    check_p.add_argument("--database", help="catalog database written by 'layout'")
    check_p.add_argument("--master", default=None)
    for p in (run_p, suite_p, layout_p, check_p):
        p.add_argument("--names", nargs="+", default=[], metavar="TABLE=NAME", help="names of the input's tables")
    args = parser.parse_args(argv)
    if args.command in ("run", "suite", "check") and bool(args.data) == bool(args.database):
        print("give exactly one of --data and --database", file=sys.stderr)
        return 2

    from mercato.plans import REPORTS
    from mercato.schema import TABLE_NAMES

    names = dict(pair.partition("=")[::2] for pair in getattr(args, "names", []))
    if not all(table in TABLE_NAMES and name for table, name in names.items()):
        print(f"--names takes TABLE=NAME with TABLE one of {', '.join(TABLE_NAMES)}", file=sys.stderr)
        return 2
    if args.command == "list":
        print("\n".join(REPORTS))
        return 0
    if args.command == "run" and args.report not in REPORTS:
        print(f"unknown report {args.report!r}; see 'python -m mercato list'", file=sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    from mercato.sources import load_tables
    from mercato.sources.bucketed import load_bucketed, write_bucketed
    from mercato.sources.files import load_catalog

    builder = SparkSession.builder.appName(f"mercato-{getattr(args, 'report', 'suite')}")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()

    if args.command == "layout":
        write_bucketed(load_tables(spark, args.data, names or None), args.database, args.buckets, args.mode)
        return 0

    def tables():
        if args.database:
            return load_catalog(spark, args.database, names) if names else load_bucketed(spark, args.database)
        return load_tables(spark, args.data, names or None)

    def write(df, path: str) -> None:
        writer = df.write.mode(args.mode)
        if args.format == "csv":
            writer = writer.option("header", True)
        getattr(writer, args.format)(path)

    if args.command == "check":
        from mercato.sources.contract import check

        broken = check(tables())
        print("\n".join(f"{rule}\t{n}" for rule, n in broken.items()) or "no rule is broken")
        return 1 if broken else 0

    if args.command == "suite":
        from mercato.plans.suite import run_tables

        timings = run_tables(
            tables(), sink=lambda name, df: write(df, f"{args.out.rstrip('/')}/{name}")
        )
        for name, sec in timings.items():
            print(f"{name}\t{sec:.2f}s")
        return 0

    df = REPORTS[args.report](tables())
    if args.out:
        write(df, args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

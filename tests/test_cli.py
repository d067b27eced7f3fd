"""The command line: list, run one report to a file, run the suite to a folder."""

from __future__ import annotations

from conftest import SF001

from mercato.__main__ import main
from mercato.plans import REPORTS
from mercato.sources import load_tables


def test_list(capsys):
    assert main(["list"]) == 0
    assert capsys.readouterr().out.split() == list(REPORTS)


def test_unknown_report():
    assert main(["run", "no_such_report", "--data", SF001]) == 2


def test_run_writes_a_report(spark, tmp_path):
    out = tmp_path / "weekday"
    assert main(["run", "revenue_by_weekday", "--data", SF001, "--out", str(out)]) == 0
    assert spark.read.parquet(str(out)).count() == 7


def test_suite_writes_every_report(spark, tmp_path):
    out = tmp_path / "all"
    assert main(["suite", "--data", SF001, "--out", str(out), "--format", "csv"]) == 0
    written = sorted(p.name for p in out.iterdir())
    assert written == sorted(REPORTS)
    got = spark.read.option("header", True).csv(str(out / "orders_by_state")).count()
    assert got == REPORTS["orders_by_state"](load_tables(spark, SF001)).count()


def test_layout_then_suite_from_the_catalog(spark, tmp_path):
    assert main(["layout", "--data", SF001, "--database", "mercato_cli_test", "--buckets", "4",
                 "--mode", "overwrite"]) == 0
    out = tmp_path / "from_db"
    assert main(["suite", "--database", "mercato_cli_test", "--out", str(out)]) == 0
    assert sorted(p.name for p in out.iterdir()) == sorted(REPORTS)


def test_data_or_database_required():
    assert main(["suite", "--out", "/tmp/unused"]) == 2

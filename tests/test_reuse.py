"""Tables kept for a state of the files: read by the next report, never stale."""

from __future__ import annotations

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from mercato.plans import REPORTS
from mercato.sources import load_tables, reuse


@pytest.fixture
def copy(spark, tmp_path):
    for name in ("customer", "nation", "orders", "lineitem", "part", "supplier"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_second_report_scans_no_lines(spark, copy):
    first = load_tables(spark, copy, reuse=True)
    REPORTS["monthly_revenue"](first).collect()
    again = load_tables(spark, copy, reuse=True)
    for name in ("monthly_revenue", "customer_spend", "revenue_by_weekday", "top_revenue_state"):
        df = REPORTS[name](again)
        assert "l_extendedprice" not in _plan(df) and "l_extendedprice" in _plan(REPORTS[name](load_tables(spark, copy)))
    assert first.shared.state is again.shared.state and len(again.shared.state.paths) >= 1


def test_every_report_is_the_same(spark, copy):
    plain, kept = load_tables(spark, copy), load_tables(spark, copy, reuse=True)
    for name, report in REPORTS.items():
        assert _rows(report(plain)) == _rows(report(kept)), name


def test_a_new_file_is_seen(spark, copy):
    before = _rows(REPORTS["monthly_revenue"](load_tables(spark, copy, reuse=True)))
    lines = spark.read.parquet(f"{copy}/lineitem.parquet")
    lines.limit(500).withColumn("l_extendedprice", F.lit(1000.0).cast(lines.schema["l_extendedprice"].dataType)).write.mode("append").parquet(f"{copy}/lineitem.parquet")
    kept = load_tables(spark, copy, reuse=True)
    got = _rows(REPORTS["monthly_revenue"](kept))
    assert got != before and got == _rows(REPORTS["monthly_revenue"](load_tables(spark, copy)))
    # copies of orders as well: the ids are checked anew
    orders = spark.read.parquet(f"{copy}/orders.parquet")
    orders.limit(20).write.mode("append").parquet(f"{copy}/orders.parquet")
    assert not kept.repeated_ids and load_tables(spark, copy, reuse=True).repeated_ids


def test_many_files_are_listed_by_a_job(spark, copy, monkeypatch):
    from mercato.sources.generated import locations

    at = locations(copy)
    few = reuse.fingerprint(spark, at)
    monkeypatch.setattr(reuse, "MOST_LISTED", 2)
    many = reuse.fingerprint(spark, at)
    assert few != many == reuse.fingerprint(spark, at)
    spark.read.parquet(f"{copy}/nation.parquet").limit(1).write.mode("append").parquet(f"{copy}/nation.parquet")
    assert reuse.fingerprint(spark, at) != many
    monkeypatch.undo()
    assert reuse.fingerprint(spark, at) != few
    with pytest.raises(FileNotFoundError):
        reuse.fingerprint(spark, [f"{copy}/none.parquet"])


def test_files_that_change_while_a_table_is_written(spark, copy, monkeypatch):
    kept = load_tables(spark, copy, reuse=True)
    monkeypatch.setattr(reuse, "fingerprint", lambda *_: ("changed",))
    REPORTS["monthly_revenue"](kept).collect()
    assert kept.shared.state.paths == {}


def test_a_folder_that_goes_and_other_columns(spark, copy):
    """A known path whose files are rewritten with one more column, or are gone."""
    load_tables(spark, copy)
    supplier = f"{copy}/supplier.parquet"
    rows = spark.createDataFrame(spark.read.parquet(supplier).collect())
    rows.withColumn("extra", F.lit(1)).write.mode("overwrite").parquet(supplier)
    assert load_tables(spark, copy).sellers.count() == rows.count()
    import pathlib

    for f in pathlib.Path(supplier).iterdir():
        f.unlink()
    pathlib.Path(supplier).rmdir()
    with pytest.raises(FileNotFoundError):
        load_tables(spark, copy)


def test_a_kept_table_that_is_gone_is_written_again(spark, copy):
    import pathlib

    first = _rows(REPORTS["monthly_revenue"](load_tables(spark, copy, reuse=True)))
    kept = load_tables(spark, copy, reuse=True)
    at = pathlib.Path(kept.shared.state.paths["order_totals"].removeprefix("file:"))
    for f in at.iterdir():
        f.unlink()
    at.rmdir()
    assert _rows(REPORTS["monthly_revenue"](kept)) == first
    assert kept.shared.state.paths["order_totals"] != str(at)


def test_without_a_shared_folder(spark, copy, monkeypatch):
    def none(_):
        raise reuse.NoSharedFolder("none")

    monkeypatch.setattr(reuse, "checkpoint_dir", none)
    assert load_tables(spark, copy, reuse=True).shared == {}

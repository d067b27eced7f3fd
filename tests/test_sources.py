"""Source adapters: the file reader (parquet and CSV) and the generated-data adapter."""

from __future__ import annotations

import pytest
from conftest import SF01
from pyspark.sql import functions as F
from test_micro_goldens import GOLDEN

from mercato.functions.money import as_doubles
from mercato.plans import REPORTS
from mercato.sources import files, generated, load_tables

SAMPLE = ["revenue_by_state", "customer_revenue_rank", "delivery_gap_days", "top_product_per_category"]


def _write(tables, root, fmt):
    for name, frame in tables.frames().items():
        writer = frame.coalesce(1).write.mode("error")
        if fmt == "csv":
            writer.option("header", True).csv(str(root / f"{name}.csv"))
        else:
            writer.parquet(str(root / f"{name}.parquet"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_file_tables_round_trip(spark, micro, tmp_path, fmt):
    _write(micro, tmp_path, fmt)
    tables = files.load(spark, str(tmp_path))
    for name in SAMPLE:
        assert [tuple(r) for r in as_doubles(REPORTS[name](tables)).collect()] == GOLDEN[name], name


def test_file_names_mapping(spark, micro, tmp_path):
    renamed = {name: f"export_{name}" for name in micro.frames()}
    for name, frame in micro.frames().items():
        frame.coalesce(1).write.parquet(str(tmp_path / f"{renamed[name]}.parquet"))
    tables = files.load(spark, str(tmp_path), names=renamed)
    assert [tuple(r) for r in REPORTS["orders_by_state"](tables).collect()] == GOLDEN[
        "orders_by_state"
    ]


def test_register_views(spark, micro):
    micro.register_views(prefix="micro_")
    got = spark.sql(
        "SELECT count(*) FROM micro_orders WHERE order_status = 'delivered'"
    ).collect()[0][0]
    assert got == 7


def test_generated_adapter_facts(spark):
    assert generated.looks_generated(spark, SF01)
    t = load_tables(spark, SF01)
    counts = {name: frame.count() for name, frame in t.frames().items()}
    assert counts == {
        "customers": 1500,
        "orders": 15000,
        "items": 60000,
        "products": 2000,
        "translation": 24,
        "payments": 60000,
        "sellers": 100,
    }
    two_states = (
        t.customers.groupBy("customer_unique_id")
        .agg(F.countDistinct("customer_state").alias("n"))
        .where("n > 1")
        .count()
    )
    assert two_states == 143
    translated = t.items.join(t.products, "product_id").join(
        t.translation, "product_category_name"
    )
    assert translated.count() == 56920
    delivered = t.orders.where("order_status = 'delivered'")
    assert delivered.count() == 4933
    assert delivered.where("order_delivered_customer_date IS NULL").count() == 74


def test_csv_header_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text("\ufeffseller_id,seller_city\ns1,x\ns2,y\n", encoding="utf-8")
    from mercato.schema import logical_schemas

    df = files.read_table(spark, str(path), "csv", logical_schemas()["sellers"])
    assert df.columns == ["seller_id"] and sorted(r[0] for r in df.collect()) == ["s1", "s2"]


def test_uris_and_appended_rows(spark, tmp_path):
    """A folder named by URI is read, and every load lists it anew."""
    import shutil

    for name in generated.RAW_TABLES:
        (tmp_path / f"{name}.parquet").mkdir()
        shutil.copy(f"{SF01}/{name}.parquet", tmp_path / f"{name}.parquet" / "part-0.parquet")
    uri = f"file://{tmp_path}"
    before = load_tables(spark, uri).orders.count()
    spark.read.parquet(f"{SF01}/orders.parquet").limit(50).write.mode("append").parquet(f"{uri}/orders.parquet")
    assert load_tables(spark, uri).orders.count() == before + 50


def test_null_persons_are_not_counted(spark):
    from dataclasses import replace

    from mercato.plans import REPORTS
    from pyspark.sql import functions as F

    t = load_tables(spark, SF01)
    t = replace(t, customers=t.customers.withColumn("customer_unique_id", F.when(F.pmod(F.xxhash64("customer_id"), F.lit(7)) != 0, F.col("customer_unique_id"))))
    known = t.orders.filter("order_status = 'delivered'").join(t.customers.filter("customer_unique_id is not null"), "customer_id")
    want = {r[0]: r[1] for r in known.groupBy("customer_state").agg(F.countDistinct("customer_unique_id")).collect()}
    got = {r["customer_state"]: r["total_customers"] for r in REPORTS["repeat_pct_by_state"](t).collect()}
    assert {k: v for k, v in got.items() if v} == want
    assert REPORTS["aov_by_segment"](t).collect() == REPORTS["aov_by_segment"](replace(t, customers=t.customers.filter("customer_unique_id is not null"))).collect()


def test_catalog_tables_are_cast_and_named(spark, micro):
    from mercato.plans import REPORTS
    from mercato.sources.files import load_catalog

    spark.sql("CREATE DATABASE IF NOT EXISTS external_micro")
    for name, frame in micro.frames().items():
        text = frame.select(*[frame[c].cast("string").alias(c) for c in frame.columns])
        text.write.mode("overwrite").saveAsTable(f"external_micro.src_{name}")
    t = load_catalog(spark, "external_micro", {name: f"src_{name}" for name in micro.frames()})
    for name in ("revenue_by_state", "customer_first_last_order"):
        assert REPORTS[name](t).collect() == REPORTS[name](micro).collect()

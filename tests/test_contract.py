"""What the tables promise: one test for each rule."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from mercato.sources.contract import IDS, KNOWN, ContractBroken, check, require, rules, violations


def test_sound_tables_break_nothing(micro):
    assert check(micro, [r for r in rules() if not r.startswith("dangling")]) == {}
    found = {r["rule"]: r["rows"] for r in violations(micro).collect()}
    assert sorted(found) == sorted(rules()) and all(n >= 0 for n in found.values())


@pytest.mark.parametrize("rule", [f"unknown {t}.{c}" for t, columns in KNOWN.items() for c in columns])
def test_unknown_values(micro, rule):
    table, _, column = rule.removeprefix("unknown ").partition(".")
    frame = getattr(micro, table)
    kind = frame.schema[column].dataType
    broken = dataclasses.replace(micro, **{table: frame.unionByName(frame.limit(2).withColumn(column, F.lit(None).cast(kind)))})
    assert check(broken, [rule]) == {rule: 2}


@pytest.mark.parametrize("column", sorted(IDS))
def test_repeated_and_dangling_ids(micro, column):
    owner, users = IDS[column]
    frame = getattr(micro, owner)
    rule = f"repeated {owner}.{column}"
    first = frame.orderBy(column).limit(1)
    twice = dataclasses.replace(micro, **{owner: frame.unionByName(first).unionByName(first)})
    assert check(twice, [rule]) == {rule: 2}
    for user in users:
        rule, rows = f"dangling {user}.{column}", getattr(micro, user)
        stray = rows.limit(3).withColumn(column, F.lit("nowhere").cast(rows.schema[column].dataType))
        before = check(micro, [rule]).get(rule, 0)
        broken = dataclasses.replace(micro, **{user: rows.unionByName(stray)})
        assert check(broken, [rule]) == {rule: before + stray.count()}
        # a NULL id is unknown, not dangling
        null = rows.limit(1).withColumn(column, F.lit(None).cast(rows.schema[column].dataType))
        assert check(dataclasses.replace(micro, **{user: rows.unionByName(null)}), [rule]).get(rule, 0) == before


def test_refusal(micro):
    some = ["repeated orders.order_id", "unknown orders.order_id"]
    assert require(micro, some) is micro
    twice = dataclasses.replace(micro, orders=micro.orders.unionByName(micro.orders))
    with pytest.raises(ContractBroken, match=r"repeated orders.order_id: \d+ rows"):
        require(twice, some)
    with pytest.raises(ValueError, match="no such rule"):
        check(micro, ["repeated items.order_id"])
    empty = dataclasses.replace(micro, **{n: f.limit(0) for n, f in micro.frames().items()})
    assert check(empty) == {}


def test_one_job_and_no_collected_ids(spark, micro):
    plan = violations(micro)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan


def test_command_line(tmp_path, spark, micro, capsys):
    from mercato.__main__ import main

    for name, frame in micro.frames().items():
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    micro.sellers.write.mode("append").parquet(str(tmp_path / "sellers.parquet"))
    assert main(["check", "--data", str(tmp_path)]) == 1
    assert f"repeated sellers.seller_id\t{micro.sellers.count()}" in capsys.readouterr().out

"""What a task holds keeps its size as the input grows."""

from __future__ import annotations

import pyarrow as pa
import pytest

from mercato import session
from mercato.plans import run
from mercato.session import BATCH_CONF, INITIAL_PARTITIONS, TASK_CONF, bound_batches, bound_tasks

SF001 = "/root/testdata/sf0.001"


@pytest.fixture
def unset(spark):
    """``spark`` without the settings at hand, which come back afterwards."""
    keys = [*TASK_CONF, INITIAL_PARTITIONS, BATCH_CONF]
    previous = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    yield spark
    for k, v in previous.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_texts_go_to_the_workers_in_batches_of_bounded_bytes(unset):
    shared = pytest.importorskip("mercato.llm.shared")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def query(spark):
        texts = spark.range(0, 24, 1, 1).selectExpr("repeat('a', 1000000) AS text")
        return texts.mapInArrow(sizes, "n long")

    found = [r["n"] for r in shared.shipped(query)(unset).collect()]
    assert len(found) > 1 and sum(found) >= 24_000_000
    assert max(found) < 6_000_000


def test_a_batch_size_of_the_caller_stays(unset):
    unset.conf.set(BATCH_CONF, "1m")
    bound_batches(unset)
    assert unset.conf.get(BATCH_CONF) == "1m"


def test_a_larger_input_starts_with_more_partitions(unset):
    few = int(unset.conf.get("spark.sql.shuffle.partitions"))
    bound_tasks(unset, 100 * few * session.PARTITION_BYTES)
    assert int(unset.conf.get(INITIAL_PARTITIONS)) == 100 * few
    bound_tasks(unset, 1)  # never lowered
    assert int(unset.conf.get(INITIAL_PARTITIONS)) == 100 * few
    assert {k: unset.conf.get(k) for k in TASK_CONF} == TASK_CONF


def test_settings_of_the_caller_stay(unset):
    for k in TASK_CONF:
        unset.conf.set(k, "5m")
    bound_tasks(unset, 1 << 40)
    assert all(unset.conf.get(k) == "5m" for k in TASK_CONF)


@pytest.mark.parametrize("name", ["repeat_orders_by_category", "products_bought_together"])
def test_reports_bound_their_tasks(unset, monkeypatch, name):
    monkeypatch.setattr(session, "PARTITION_BYTES", 1_000)
    run(unset, SF001, name)
    few = int(unset.conf.get("spark.sql.shuffle.partitions"))
    assert int(unset.conf.get(INITIAL_PARTITIONS)) > few
    assert unset.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == TASK_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"]

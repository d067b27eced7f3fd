"""Whitening against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from mercato.llm import whitening
from mercato.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, id long, x string, whitened double"


def reference(vectors: list) -> tuple:
    wide = max(map(len, vectors))
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in [*v, *[0.0] * (wide - len(v))]] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array(x, float) - np.array([s / n for s in sums])
    values, vec = np.linalg.eigh(centred.T @ centred / n)
    values, vec = values[::-1], vec[:, ::-1]
    k = min(32, int((values > values.max() * wide * np.finfo(float).eps).sum()))
    return x, sums, values, centred @ vec[:, :k] / np.sqrt(values[:k])


def check(got: list, ids: list, vectors: list) -> None:
    x, sums, values, white = reference(vectors)
    n = len(vectors)
    rows: dict = {}
    for r in got:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == white.size
    want = {i: w for i, w in zip(ids, white)}
    some = rows[ids[0]]
    signs = [np.sign(some[c + 1]["whitened"] * want[ids[0]][c]) for c in range(white.shape[1])]
    for i, v in zip(ids, x):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
        for c, r in rows[i].items():
            assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] <= 1e-9
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert r["whitened"] == pytest.approx(signs[c - 1] * want[i][c - 1], abs=1e-6)


def test_whitening(spark, monkeypatch):
    """Rows that take no part, short ones, repeated vectors, blocks smaller than the
    table both ways, and clashing columns."""
    monkeypatch.setattr(whitening, "FEWEST_ROWS", 16)
    monkeypatch.setattr(whitening, "MOST_COLUMNS", 5)
    monkeypatch.setattr(whitening, "BLOCKS_TOGETHER", 2)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12))).tolist() + [[1.0] * 12] * 40 + [[0.5, 2.0], []]
    rows = list(enumerate(vectors))
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [1.0] * 11 + [float("-inf")])]
    df = spark.createDataFrame([(*r, 1, "x", 0.0) for r in rows + bad], SCHEMA).repartition(5)
    got = whitening.components_of(*whitening.whiten(df)).withColumnRenamed("id", "vec_id").collect()
    check(got, [i for i, _ in rows], vectors)
    # repeated and null ids
    twice = spark.createDataFrame([(None if i < 3 else 7, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.components_of(*whitening.whiten(twice, components=2)).collect()
    assert len(got) == 2 * len(vectors) and sum(r["id"] is None for r in got) == 6


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whitening.components_of(*whitening.whiten(df)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.components_of(*whitening.whiten(flat)).collect()
    assert {r["component"] for r in got} == {1} and all(r["identity_error"] < 1e-9 for r in got)


def test_query(spark):
    got = QUERIES["op13_block_whitening"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    check(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])

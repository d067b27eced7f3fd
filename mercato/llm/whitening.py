"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Vectors become whole numbers, ``x = floor(64 * c) + 1000000``, so that sums are exact.
The rows, less the mean, are indexed and laid out as a distributed ``BlockMatrix`` A.
``A' A`` is the scatter: the products of row blocks are added where the blocks lie, a
few blocks at a time, and only the dims x dims result comes to the driver, whose
eigenvectors over the square roots of their eigenvalues make the whitening matrix W.
``A W`` projects all rows as a second BlockMatrix product. The whitened rows go
through the same scatter again, which measures how far they are from white.

Defined cases: vectors that are null or hold null or non-finite entries take no part;
shorter vectors, empty ones included, are filled up with zero entries to the longest;
null and repeated ids are rows like any others; directions without variance (all of
them if there is one row, or if all rows are equal) give no component; an empty table
gives an empty result; other columns are ignored. Numbers beyond a long are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.shared import save

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows of a block: enough blocks for a small table, and 8 MB or less for 128 dims.
FEWEST_ROWS, MOST_ROWS, MOST_COLUMNS = 256, 8_192, 1_024
#: Blocks of rows whose products one task adds up.
BLOCKS_TOGETHER = 8
#: Up to so many partitions the places of their rows are broadcast (2 MB).
BROADCAST_PARTITIONS = 100_000


@dataclass
class Whitening:
    """What was fitted. ``values`` and ``vectors`` (columns) belong to the components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, index): the rows that take part, numbered from 0, written once."""
    c = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("c"))
    bad = F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    c = c.filter(F.col("c").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = save(c.select("id", x.alias("x"), F.monotonically_increasing_id().alias("at")), "rows")
    part, bits = F.shiftright("at", 33).alias("part"), (1 << 33) - 1
    parts = rows.groupBy(part).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = save(parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")), "parts")
    small = parts.count() <= BROADCAST_PARTITIONS
    rows = rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts) if small else parts, "part")
    return rows.select("id", "x", (F.col("base") + F.col("at").bitwiseAND(bits)).alias("index"))


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """``rows`` (index, array of doubles) as blocks; all of it stays in the JVM."""
    frame = rows.select(F.col("index").cast("long"), array_to_vector(rows.columns[1]).alias("vector"))
    frame = MLUtils.convertVectorColumnsFromML(frame, "vector")
    height = min(MOST_ROWS, max(FEWEST_ROWS, n // 64))
    return IndexedRowMatrix(frame, n, dims).toBlockMatrix(height, min(dims, MOST_COLUMNS))


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """``matrix' matrix``. Splitting the long dimension keeps the products of
    different row blocks in different tasks; their sums are dims x dims."""
    splits = max(1, -(-n // (matrix.rowsPerBlock * BLOCKS_TOGETHER)))
    left, right = matrix.transpose()._java_matrix_wrapper._java_model, matrix._java_matrix_wrapper._java_model
    product = left.multiply(right, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _centred(rows: DataFrame, mean: Column) -> DataFrame:
    return rows.select("index", F.zip_with(rows.columns[-1], mean, lambda v, m: v - m).alias("v"))


def _local_block_matrix(spark: SparkSession, values: np.ndarray) -> BlockMatrix:
    """A small matrix as blocks no larger than ``MOST_COLUMNS`` both ways."""
    step = MOST_COLUMNS
    blocks = [
        ((i // step, j // step), DenseMatrix(*(part := values[i : i + step, j : j + step]).shape, part.ravel(order="F").tolist()))
        for i in range(0, values.shape[0], step)
        for j in range(0, values.shape[1], step)
    ]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), min(step, values.shape[0]), min(step, values.shape[1]), *values.shape)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame, BlockMatrix | None]:
    """The whitening of ``quantised`` rows, the rows filled up, and their blocks."""
    found = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    n, dims = found[0], found[1] or 0
    if not n or not dims:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0), rows, None
    missing = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", missing))
    per = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum("v").alias("s"))
    sums = [r["s"] for r in per.orderBy("dim").collect()]  # one row per dimension
    centred = _centred(rows.select("index", F.transform("x", lambda v: v.cast("double")).alias("x")), _literal([s / n for s in sums]))
    blocks = block_matrix(centred, n, dims)
    covariance = scatter(blocks, n) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * dims * np.finfo(float).eps]
    return Whitening(n, sums, values[order], vectors[:, order], float(np.trace(covariance))), rows, blocks


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """(per row id, x, whitened (array, by component); what was fitted; the largest
    absolute entry of the whitened rows' covariance less the identity)."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col)
    fitted, rows, blocks = fit(rows, components)
    k = len(fitted.values)
    if not k:
        nothing = rows.select("id", "x", F.array().cast("array<double>").alias("whitened"))
        return nothing, fitted, 0.0
    product = blocks.multiply(_local_block_matrix(spark, fitted.matrix)).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    projected = save(projected.select("index", vector_to_array("vector").alias("whitened")), "whitened")
    means = projected.select(F.posexplode("whitened").alias("c", "v")).groupBy("c").agg(F.avg("v").alias("m"))
    mean = _literal([r["m"] for r in means.orderBy("c").collect()])
    white = scatter(block_matrix(_centred(projected, mean), fitted.n, k), fitted.n) / fitted.n
    return rows.join(projected, "index").select("id", "x", "whitened"), fitted, float(np.abs(white - np.eye(k)).max())


def deviation(fitted: Whitening) -> Column:
    """Per row the exact sum over dimensions of ``(n * x - S) ** 2``."""
    wide = "decimal(38,0)"
    steps = F.zip_with("x", _literal(fitted.sums), lambda v, s: v * fitted.n - s)
    zero = F.lit(0).cast(wide)
    return F.aggregate(steps, zero, lambda total, d: (total + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast(wide)).cast(wide))


def components_of(white: DataFrame, fitted: Whitening, error: float) -> DataFrame:
    """One row per row and component: id, component (from 1), n, deviation, whitened,
    explained, identity_error."""
    explained = _literal([float(v / fitted.trace) for v in fitted.values]) if len(fitted.values) else F.array().cast("array<double>")
    each = white.select("id", deviation(fitted).alias("deviation") if fitted.sums else F.lit(0).alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

"""Exact top-k by inner product over a bit-sliced index.

Every component is quantised to ``floor(256 * x)``. The index is a table of blocks of
rows; a block stores each attribute as bit slices, as many as its values need: slice
``i`` is a bitmap over the block's rows with bit ``i`` of their values (offset by the
attribute's least value, so all are non-negative). A query's score is a weighted sum of attributes, so it is added
up with bitmap arithmetic alone: for bit ``c`` of the query's components, the
sums of the attributes that have the bit are taken from a table made once per
block (all subsets of ``GROUP`` attributes, summed slice by slice) and added,
shifted by ``c``, with ripple-carry adders. The top rows are then selected from
the most significant slice of the sum downward; rows that tie at the boundary
are resolved exactly by the smaller id.

The index is built where the rows lie, one block of at most ``BLOCK_ROWS`` rows
after the other, without a shuffle. The query set meets it in tiles, one block
of queries against one block of rows; the tiles of ``QUERY_BLOCKS`` query blocks and one
block of rows are in one task, which makes the block's subset tables once. Each tile
returns at most k rows per query, and a window per query keeps the best k.

Defined cases: vectors that are null or hold null or non-finite components take no
part; every other one does, whatever its size. A component beyond a long, and a score of
a query beyond a long, are errors. Vectors of different lengths, empty ones included, are
compared as if filled up with zeros; null ids take no part; a row with the query's own id is no candidate; repeated
rows are candidates each; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.shared import save

SCALE = 256.0
#: Rows and queries of a tile, and the tiles of one block of rows in one task.
BLOCK_ROWS, BLOCK_QUERIES, QUERY_BLOCKS = 8_192, 512, 64
#: Attributes whose subset sums are tabled together, and queries added at once.
GROUP, TOGETHER = 6, 32


def quantised(vectors: list, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as integers, filled up with zeros)."""
    good = [i for i, v in enumerate(vectors) if v is not None]
    wide = max([1, *(len(vectors[i]) for i in good)])
    out, keep = np.zeros((len(good), wide), np.int64), np.ones(len(good), bool)
    for r, i in enumerate(good):
        v = np.array([np.nan if x is None else x for x in vectors[i]], np.float64)
        if not np.isfinite(v).all():
            keep[r] = False
            continue
        q = np.floor(v * scale)
        if (np.abs(q) >= 2.0**63).any():
            raise ArithmeticError("a component is beyond a long")
        out[r, : len(v)] = q
    return np.array(good, np.int64)[keep], out[keep]


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bit slices (bits, words) of unsigned ``values``, 64 rows a word."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    room = -(-len(values) // 64) * 64
    padded = np.zeros(room, np.uint64)
    padded[: len(values)] = values
    return np.stack([np.packbits(((padded >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for i in range(bits)])


def plus(a: list[np.ndarray], b: list[np.ndarray], shift: int = 0) -> list[np.ndarray]:
    """Slices of ``a + (b << shift)`` by ripple carry."""
    out, carry = list(a[:shift]), None
    zero = None
    for i in range(shift, max(len(a), len(b) + shift)):
        x = a[i] if i < len(a) else zero
        y = b[i - shift] if i - shift < len(b) else zero
        terms = [t for t in (x, y, carry) if t is not None]
        if not terms:  # a gap between the two
            out.append(np.zeros_like(b[0]))
        elif len(terms) == 1:
            out.append(terms[0])
            carry = None
        elif len(terms) == 2:
            out.append(terms[0] ^ terms[1])
            carry = terms[0] & terms[1]
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    if carry is not None:
        out.append(carry)
    return out


class Block:
    """The index of one block of rows: ids, and for each attribute its least value
    and bit slices."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: list[np.ndarray]):
        self.ids, self.rows, self.low, self.slices = ids, len(ids), low, slices
        self.words = -(-self.rows // 64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        low = values.min(axis=0)
        # wraps around as unsigned, so the whole range of a long will do
        return cls(ids, low, [slices_of(values[:, j].view(np.uint64) - low[j : j + 1].view(np.uint64)) for j in range(values.shape[1])])

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        """ids, least values, slices of each attribute, and all slices."""
        return self.ids.tobytes(), self.low.tobytes(), np.array([len(s) for s in self.slices], np.int32).tobytes(), np.concatenate(self.slices).tobytes()

    @classmethod
    def read(cls, ids: bytes, low: bytes, bits: bytes, slices: bytes) -> Block:
        ids = np.frombuffer(ids, np.int64)
        every = np.frombuffer(slices, np.uint64).reshape(-1, -(-len(ids) // 64))
        return cls(ids, np.frombuffer(low, np.int64), np.split(every, np.cumsum(np.frombuffer(bits, np.int32))[:-1]))

    def values(self) -> np.ndarray:
        """The quantised components again, as Python integers."""
        out = np.zeros((self.rows, len(self.slices)), object)
        for j, part in enumerate(self.slices):
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")[:, : self.rows]
            out[:, j] = sum((b.astype(object) << i for i, b in enumerate(bits)), np.zeros(self.rows, object)) + int(self.low[j])
        return out

    def tables(self) -> list[np.ndarray]:
        """For each group of attributes the slices of every subset's sum:
        (2^GROUP, bits, words)."""
        out = []
        for at in range(0, len(self.slices), GROUP):
            part = self.slices[at : at + GROUP]
            sums: list[list[np.ndarray]] = [[np.zeros(self.words, np.uint64)]]
            for s in part:
                sums += [plus(x, list(s)) for x in sums]
            bits = max(map(len, sums))
            table = np.zeros((len(sums), bits, self.words), np.uint64)
            for i, x in enumerate(sums):
                table[i, : len(x)] = x
            # highest slices that no subset fills are left out
            used = int(np.flatnonzero(table.any(axis=(0, 2))).max(initial=0)) + 1
            out.append(table[:, :used])
        return out

    def top(self, tables: list[np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, row ids, scores) of the k best rows for each query."""
        dims = len(self.slices)
        q = np.zeros((len(queries), dims), np.int64)
        common = min(dims, queries.shape[1])
        q[:, :common] = queries[:, :common]
        # what a sum of slices can reach must stay well within 64 bits
        size = [2.0 ** len(s) for s in self.slices] + np.abs(self.low.astype(float))
        if (np.abs(q.astype(float)) * size).sum(axis=1).max(initial=0) * 4 >= 2.0**62:
            yield from self._large(query_ids, q, k)
            return
        bits = max(1, int(max(q.max(initial=0), -q.min(initial=0) - 1)).bit_length() + 1)  # two's complement
        masks = []  # per group and bit: which subset of its attributes has the bit
        for g in range(0, dims, GROUP):
            part = q[:, g : g + GROUP]
            masks.append([(((part >> c) & 1) << np.arange(part.shape[1])).sum(axis=1) for c in range(bits)])
        for at in range(0, len(q), TOGETHER):
            yield from self._some(tables, [[m[at : at + TOGETHER] for m in g] for g in masks], bits, query_ids[at : at + TOGETHER], q[at : at + TOGETHER], k)

    def _large(self, query_ids, q, k):
        """The same with integers of any size, for values that 64 bits may not hold."""
        values = self.values()
        for i, query in zip(query_ids.tolist(), q.astype(object)):
            scores = values @ query
            best = sorted((-int(s), r) for s, r in zip(scores, self.ids.tolist()) if r != i)[:k]
            if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in best):
                raise ArithmeticError("a score is beyond a long")
            if best:
                yield i, np.array([r for _, r in best], np.int64), np.array([-s for s, _ in best], np.int64)

    def _some(self, tables, masks, bits, query_ids, q, k):
        n = len(q)
        sums = []
        for c in range(bits):  # the attributes that have bit c, summed
            total: list[np.ndarray] = []
            for table, mask in zip(tables, masks):
                picked = table[mask[c]]  # (queries, slices, words)
                total = plus(total, [picked[:, i] for i in range(picked.shape[1])]) if total else [picked[:, i] for i in range(picked.shape[1])]
            sums.append(total)
        # the top bit counts negative: its complement is added, which shifts all scores alike
        sums[-1] = [~x for x in sums[-1]]
        wide = len(sums[-1])
        score = sums[0]
        for c in range(1, bits):
            score = plus(score, sums[c], c)
        constant = q @ self.low - ((1 << wide) - 1 << (bits - 1))
        valid = np.zeros((n, self.words), np.uint64)
        valid[:] = np.packbits(np.arange(self.words * 64) < self.rows, bitorder="little").view(np.uint64)
        order = np.argsort(self.ids, kind="stable")
        a, b = np.searchsorted(self.ids[order], query_ids), np.searchsorted(self.ids[order], query_ids, "right")
        for i in np.flatnonzero(b > a):  # not the query's own rows
            own = order[a[i] : b[i]]
            np.bitwise_and.at(valid[i], own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        sure, open_ = np.zeros_like(valid), valid
        for s in reversed(score):  # from the most significant slice down
            ones = open_ & s
            count = np.bitwise_count(sure | ones).sum(axis=1)
            more = (count > k)[:, None]  # too many: only these can be among the top
            sure, open_ = np.where(more, sure, sure | ones), np.where(more, ones, open_ & ~s)
        for i in range(n):
            rows = np.flatnonzero(np.unpackbits((sure[i] | open_[i]).view(np.uint8), bitorder="little"))
            if not len(rows):
                continue
            word, bit = rows >> 6, (rows & 63).astype(np.uint64)
            values = np.zeros(len(rows), np.int64)
            for p, s in enumerate(score):
                values += ((s[i][word] >> bit) & np.uint64(1)).astype(np.int64) << p
            best = np.lexsort((self.ids[rows], -values))[:k]
            yield int(query_ids[i]), self.ids[rows[best]], values[best] + constant[i]


ROWS, QUERIES = "block long, ids binary, low binary, bits binary, slices binary", "block long, ids binary, dims long, values binary"


def _blocks(frame: DataFrame, rows: int, schema: str):
    """Blocks of at most ``rows`` quantised rows: an index, or plain queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out(pieces):
            ids = np.concatenate([i for i, _ in pieces])
            wide = max(v.shape[1] for _, v in pieces)
            values = np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, v in pieces])
            made = Block.of(ids, values).stored() if schema == ROWS else (ids.tobytes(), wide, values.astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in ((part << 32) + n, *made)], [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            keys = b.column(0).to_pylist()
            for at in range(0, len(keys), rows):
                good, values = quantised([None if k is None else v for k, v in zip(keys[at : at + rows], b.column(1).slice(at, rows).to_pylist())])
                ids = np.array([keys[at + i] for i in good], np.int64)
                while len(ids):
                    take = rows - size
                    held.append((ids[:take], values[:take]))
                    size += len(held[-1][0])
                    ids, values = ids[take:], values[take:]
                    if size == rows:
                        yield out(held)
                        n, held, size = n + 1, [], 0
        if size:
            yield out(held)

    return frame.mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows."""
    def two(df: DataFrame) -> DataFrame:
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v"))

    rows = save(_blocks(two(vectors), block_rows, ROWS), "blocks")
    asked = save(_blocks(two(queries), block_queries, QUERIES), "queries")
    nr, nq = rows.count(), asked.count()
    # a tile is one block of queries and one of rows: both are repeated for the
    # blocks of the other side, so that the tiles are spread over all tasks
    number = Window.orderBy("block")  # one row per block

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.join(df.select("block", (F.row_number().over(number) - 1).alias(name)), "block").drop("block")

    left = numbered(asked, "qb").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(max(nr - 1, 0)))))
    right = numbered(rows, "rb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(nq - 1, 0)))))
    right = right.select("qb", "rb", F.col("ids").alias("row_ids"), "low", "bits", "slices")
    tiles = left.join(right, ["qb", "rb"]).select("rb", (F.col("qb") / QUERY_BLOCKS).cast("long").alias("qg"), "dims", "ids", "values", "row_ids", "low", "bits", "slices")
    groups = max(1, min(nr * -(-nq // QUERY_BLOCKS), 20_000))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, tables = None, None, []
        for b in batches:
            for rb, dims, ids, values, *index in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8))):
                if rb != last:
                    last, block = rb, Block.read(*index)
                    tables = block.tables()
                ids = np.frombuffer(ids, np.int64)
                found = list(block.top(tables, ids, np.frombuffer(values, "<i8").reshape(-1, dims), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in ([np.full(len(r), i) for i, r, _ in found], [r for _, r, _ in found], [s for *_, s in found])],
                    ["query_id", "vec_id", "score"],
                )

    spread = tiles.repartition(groups, "rb", "qg").sortWithinPartitions("rb")
    best = spread.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

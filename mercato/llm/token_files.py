"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are renumbered by falling frequency over the whole corpus, so the common
ones take one byte and nearly all others two. Each rank is stored in 1 to 4
little-endian bytes; the lengths sit apart, four to a control byte (two bits
each, first id lowest). A decoder looks the four lengths of a control byte up in
a table and gathers the data bytes with numpy; nothing is parsed byte by byte.

A file set is a folder in shared storage, written by Spark's own committer, so a
lost task leaves nothing half written:

  ``ranks``   (rank, id): the table of the coding, at most the vocabulary
  ``blocks``  in ascending id order; one row per block of whole documents with
              part, block, doc_ids and counts (int64 arrays), control, data

``start`` is not stored: it follows from the counts and the parts' totals.

Defined cases: a null text is empty and has the end id only; null ids come
first; repeated ids are ordered by their tokens; an empty table gives an empty
file set; other columns are ignored. One document lies in one block, so a block
is as large as ``BLOCK_IDS`` or its only document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.shared import save, work_path
from mercato.llm.tokens import default_vocabulary, encoder, in_batches

END_ID = 2
BLOCK_IDS = 1 << 18
NO_ID = -(1 << 63)
#: Up to so many blocks their places in the sequence (a few MB) are broadcast.
BROADCAST_BLOCKS = 100_000
#: Bytes a writer holds before it puts a row group into its file.
ROW_GROUP = 16 << 20
#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit unsigned ``ranks``."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of ``pack``."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encode(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = np.dtype(enc.dtype).itemsize
        for batch in batches:
            for ids, texts in in_batches(batch.column(0), batch.column(1)):
                coded = enc.encode(texts, end_id)
                yield pa.RecordBatch.from_arrays([ids, pa.array(coded, pa.binary()), pa.array([len(x) // width for x in coded], pa.int64())], ["doc_id", "ids", "n"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n long")


def _counted(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=len(total))
            found[: len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` into a file set at ``path``."""
    spark = docs.sparkSession
    # texts are encoded once; counting, ranging and coding read the ids
    encoded = work_path(spark, "ids")
    vocabulary = vocabulary or default_vocabulary()
    dtype = encoder(vocabulary).dtype
    width = np.dtype(dtype).itemsize
    _encode(docs, id_col, text_col, vocabulary, end_id).write.option("parquet.block.size", ROW_GROUP).parquet(encoded)
    ids = spark.read.schema("doc_id long, ids binary, n long").parquet(encoded)
    counts = ids.select("ids").mapInArrow(_counted(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most the vocabulary: its size bounds what the driver and each task hold
    order = np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()], np.int64)
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(order)), pa.int64()), "id": pa.array(order, pa.int64())})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            control, data = pack(rank_of[np.frombuffer(b"".join(x for _, x in held), dtype)])
            keys, counts = np.array([k for k, _ in held], np.int64), np.array([len(x) // width for _, x in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, block, keys.tobytes(), counts.tobytes(), control, data)], ["part", "block", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.as_py()
                if held and size + len(x) // width > BLOCK_IDS:
                    yield out()
                    block, held, size = block + 1, [], 0
                held.append((NO_ID if key is None else key, x))
                size += len(x) // width
        if held:
            yield out()

    # the hash parts rows that share an id, so that no range is one id's alone
    ranged = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "ids")
    ranged.mapInArrow(blocks, "part long, block long, doc_ids binary, counts binary, control binary, data binary").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start, n_tokens and ids (little-endian 32-bit)."""
    order = np.array([r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.schema("part long, block long, doc_ids binary, counts binary, control binary, data binary").parquet(f"{path}/blocks")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(np.frombuffer(x.as_py(), np.int64).sum()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["part", "block", "n"])

    n = blocks.select("part", "block", "counts").mapInArrow(sizes, "part long, block long, n long")
    parts = n.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per file
    parts = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = n.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("base") + F.col("within")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, keys, counts, control, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                ids = order[unpack(control, data, int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                raw, starts = ids.tobytes(), ends - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64(), mask=keys == NO_ID),
                        pa.array(base + starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    bases = save(bases, "bases")
    small = bases.count() <= BROADCAST_BLOCKS
    return blocks.join(F.broadcast(bases) if small else bases, ["part", "block"]).select("base", "doc_ids", "counts", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")



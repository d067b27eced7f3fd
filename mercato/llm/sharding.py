"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; sorted by
fractional rank ``(rank + 1/2) / rows of the source`` the sources interleave in
proportion, so any contiguous cut has the mixture of the whole. The sequence is
cut into shards whose row counts differ by one at most.

Both ranks are global but no window sees a whole source or the whole table: the
hash (uniform by construction) and the fractional rank (uniform by meaning) are
first cut into buckets of about ``rows_per_bucket`` rows, rows are numbered
inside their bucket, and a running sum over the bucket counts gives the offsets.
Many sources of one size share their fractions, as all those of one row do: a bucket
over ``CROWDED`` times its aim is numbered in parts, by fraction and the source's hash,
with a running sum over the parts.

Defined cases: a null source is a stratum of its own; null ids and repeated
rows are ordered by what else the row holds, and fully equal rows are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.shared import save

ROWS_PER_BUCKET, CROWDED = 1_024, 4
#: Most buckets, which bounds the one window over bucket counts.
MAX_BUCKETS = 100_000


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per document: id, size (bytes + 1), text_crc32, law (``rows``), shard,
    slot (gapless from 0 within the shard) and grown_shard (null: adding a shard
    re-cuts the sequence)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("__id"),
        docs[source_col].isNull().alias("no_source"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = save(rows.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__id", "size", "text_crc32"), 1)), "sizes")
    total = rows.count()
    buckets = max(1, min(MAX_BUCKETS, -(-total // rows_per_bucket)))

    stratum = ["no_source", "stratum"]
    rows = rows.withColumn("cell", F.floor(F.shiftrightunsigned("u", 32) * F.lit(buckets) / F.lit(1 << 31)))
    cells = rows.groupBy(*stratum, "cell").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy(*stratum).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*stratum, "cell", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*stratum)).alias("of"))
    inside = Window.partitionBy(*stratum, "cell").orderBy("u", "__id", "size", "text_crc32")
    ranked = rows.withColumn("rn", F.row_number().over(inside)).join(cells, [*stratum, "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rn") - 1).withColumn("frac", (F.col("rank") + 0.5) / F.col("of"))
    ranked = save(ranked.select("__id", "size", "text_crc32", *stratum, "rank", "frac", F.least(F.floor(F.col("frac") * buckets), F.lit(buckets - 1)).alias("slice")), "ranks")

    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket, MAX_BUCKETS at most
    running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = save(slices.select("slice", "n", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")), "slices")
    whole = ranked.join(slices, "slice")
    crowded = F.col("n") > CROWDED * rows_per_bucket
    inside = Window.partitionBy("slice").orderBy("frac", *stratum, "rank")
    ordinary = whole.filter(~crowded).withColumn("pos", F.col("before") + F.row_number().over(inside) - 1)
    # parts of about the aim: rows of one fraction are parted by their source
    part = F.pmod(F.xxhash64(*stratum), F.greatest(F.lit(1).cast("long"), F.expr(f"n div {rows_per_bucket}")))
    parted = whole.filter(crowded).withColumn("part", part)
    parts = parted.groupBy("slice", "frac", "part").agg(F.count(F.lit(1)).alias("of"))
    earlier = Window.partitionBy("slice").orderBy("frac", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("slice", "frac", "part", F.coalesce(F.sum("of").over(earlier), F.lit(0)).alias("within"))
    inside = Window.partitionBy("slice", "frac", "part").orderBy(*stratum, "rank")
    numbered = parted.withColumn("rn", F.row_number().over(inside)).join(parts, ["slice", "frac", "part"])
    numbered = numbered.withColumn("pos", F.col("before") + F.col("within") + F.col("rn") - 1)
    names = ["__id", "size", "text_crc32", "pos"]
    placed = ordinary.select(names).unionByName(numbered.select(names))
    at = F.expr(f"(pos * {shards}) div {max(total, 1)}")
    return placed.withColumn("__shard", at).select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.expr(f"pos - (__shard * {total} + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights.

Tokens are summed per source; the targets follow from the weights by filling up
to a cap; each document is then emitted ``floor(rate)`` times plus one more time
with probability equal to the fraction, drawn from a hash of the document, so
that reruns agree and no row needs its neighbours.

Defined cases: a null text has no tokens; a null source is a source of its own,
the last; a source without tokens has target 0; rows that agree in id, source
and size draw alike; an empty table gives an empty result; other columns are
carried by ``mix`` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.shared import attach, save

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MAX_REPEATS = 3
#: Up to so many sources the table of rates (under 1 MB) is broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """Per source its size, target and rate, from rows (source, size).

    Weights 1, 2, 3 repeat over the sources by code point, null last. A target
    stops at ``cap`` times its source's size and the excess is shared by weight
    among the rest, until none is above. In the order of size per weight the
    capped sources come first, so running sums decide in one pass which they
    are. The two windows below see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n_docs"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    w = per.withColumn("rank", F.row_number().over(named)).withColumn("w", ((F.col("rank") - 1) % 3 + 1).cast("long"))
    everyone = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("s") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    x = w.select(
        "*",
        F.sum("s").over(everyone).alias("t"),
        F.sum("w").over(everyone).alias("ws"),
        F.coalesce(F.sum(F.col("s") * cap).over(before), F.lit(0)).alias("s0"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"),
    ).withColumn("capped", (F.col("t") - F.col("s0")) * F.col("w") > F.col("s") * cap * (F.col("ws") - F.col("w0")))
    x = x.withColumn("s1", F.sum(F.when(F.col("capped"), F.col("s") * cap).otherwise(0)).over(everyone)).withColumn("w1", F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everyone))
    share = ((F.col("t") - F.col("s1")) * F.col("w")).cast("double") / (F.col("ws") - F.col("w1")).cast("double")
    target = F.when(F.col("capped"), (F.col("s") * cap).cast("double")).otherwise(share)
    rate = F.when(F.col("capped") & (F.col("s") > 0), F.lit(float(cap))).when(F.col("s") > 0, F.least(target / F.col("s"), F.lit(float(cap)))).otherwise(0.0)
    return x.select("source", F.col("s").alias("source_size"), "n_docs", F.col("w").alias("weight"), target.alias("target"), rate.alias("rate"))


def _with_copies(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (source, __id, size, ...) with its source's figures and ``copies``."""
    rates = save(source_rates(rows.select("source", "size")), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        r = rates.withColumnRenamed("source", "__source")
        joined = rows.join(F.broadcast(r), rows["source"].eqNullSafe(r["__source"]), "left").drop("__source")
    else:
        joined = attach(rows, rates, ["source"], "n_docs", ["__id", "size"])
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    whole = F.floor("rate")
    return joined.withColumn("copies", whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """Per document: id, size, its source's size and target, and ``copies``."""
    rows = docs.select(docs[id_col].alias("__id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"))
    return _with_copies(rows, seed).withColumnRenamed("__id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"))
    taken = _with_copies(rows, seed).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")

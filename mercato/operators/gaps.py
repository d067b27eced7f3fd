"""Gap to the previous event of the same key, without one task per key.

``LAG(ts) OVER (PARTITION BY key ORDER BY ts)`` buffers a key's whole history in
one task; a key holding a third of all rows would be a third of the job in one
task. The output of that LAG is determined by the sorted multiset of timestamps
of the key: every distinct timestamp ``t`` with multiplicity ``m`` contributes
``(previous distinct timestamp, t)`` once (if there is an earlier one) and
``(t, t)`` ``m - 1`` times. So:

1. collapse rows to distinct ``(key, ts)`` with multiplicity (map-side combine): one
   shuffle, which all that follows reads;
2. one window pass partitioned by ``(key, day)`` gives the previous timestamp inside
   the day; its partitions are bounded by the distinct timestamps of one key in one
   day, not by the key's history;
3. the first timestamp of a day gets a carry: each (key, day) is one row with its
   first and last timestamp, and a LAG over those rows, bounded by the calendar span,
   hands the last one on to the key's next day;
4. the ``m - 1`` repeats are generated in chunks of at most ``chunk`` rows, and
   the chunks are spread by a shuffle, so no single row expands without bound.

Nothing is checkpointed and no job runs while the plan is built: the three outputs
have the same aggregate below them, column for column, so Spark runs it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 4096


def previous_event(
    df: DataFrame,
    key: str,
    ts: str,
    prev: str = "previous",
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Rows ``(key, prev, ts)`` with ``prev`` not NULL, as ``LAG`` followed by
    ``WHERE prev IS NOT NULL`` gives: one per input row except each key's first.

    A NULL timestamp is never anyone's previous event under that filter (it sorts
    first, so it only precedes a key's earliest real timestamp, whose pair is then
    dropped), so rows with a NULL ``ts`` are left out up front.
    """
    known = df.where(F.col(ts).isNotNull())
    distinct = known.groupBy(key, ts).agg(F.count(F.lit(1)).alias("_m"))
    # every reader keeps the count, so that all have the same aggregate below them
    day = Window.partitionBy(key, "_day").orderBy(ts)
    within_day = (
        distinct.where(F.col("_m") > 0)
        .withColumn("_day", F.to_date(ts))
        .withColumn(prev, F.lag(ts).over(day))
        .where(F.col(prev).isNotNull())
        .select(key, prev, ts)
    )

    days = distinct.groupBy(key, F.to_date(ts).alias("_day")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_m").alias("_rows")
    )
    day_starts = (
        days.where(F.col("_rows") > 0)
        .withColumn(prev, F.lag("_last").over(Window.partitionBy(key).orderBy("_day")))
        .where(F.col(prev).isNotNull())
        .select(key, prev, F.col("_first").alias(ts))
    )

    repeated = distinct.where(F.col("_m") > 1).withColumn("_extra", F.col("_m") - 1)
    n_chunks = F.ceil(F.col("_extra") / F.lit(chunk)).cast("int")
    chunks = repeated.select(
        key, ts, "_extra", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("_c")
    ).repartition(key, ts, "_c")
    size = F.least(F.lit(chunk), F.col("_extra") - F.col("_c") * chunk).cast("int")
    repeats = chunks.select(
        key, F.col(ts).alias(prev), ts, F.explode(F.sequence(F.lit(1), size)).alias("_r")
    ).drop("_r")

    return within_day.unionByName(day_starts).unionByName(repeats)

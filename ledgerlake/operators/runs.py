"""Per-key sequences: sessions with carried values, counts in a trailing window.

A key may be very hot, so nothing is windowed over a whole key. Rows are windowed inside (key, time
bucket); one summary row per bucket carries state from bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_session_values(turns: DataFrame, key: str, ts: str, value: str, order: str,
                         idle_seconds: int = 1800, bucket_seconds: int = 86400) -> DataFrame:
    """Adds `inherited`: the value of the turn, or else the last value seen before in the session.

    A session ends after idle_seconds without a turn. `ts` are seconds.
    """
    t = turns.withColumn("_b", F.floor(F.col(ts) / bucket_seconds))
    inside = Window.partitionBy(key, "_b").orderBy(ts, order)
    t = t.withColumn("_prev", F.lag(ts).over(inside))
    ends = t.groupBy(key, "_b").agg(F.max(ts).alias("_last"))
    chain = Window.partitionBy(key).orderBy("_b")
    ends = ends.withColumn("_before", F.lag("_last").over(chain)).drop("_last")
    t = t.join(ends, [key, "_b"])
    prev = F.coalesce("_prev", "_before")
    t = t.withColumn("_new", (prev.isNull() | (F.col(ts) - prev > idle_seconds)).cast("int"))
    t = t.withColumn("_seg", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy(key, "_b", "_seg").orderBy(ts, order)
    t = t.withColumn("_local", F.last(value, ignorenulls=True).over(
        seg.rowsBetween(Window.unboundedPreceding, 0)))
    # what each bucket hands on: its session number at the end and the value in force there
    tail = t.groupBy(key, "_b").agg(
        F.sum("_new").alias("_starts"), F.max("_seg").alias("_end_seg"),
        F.max(F.when(F.col(value).isNotNull(), F.struct("_seg", ts, order, value))).alias("_lastval"))
    tail = tail.withColumn("_total", F.sum("_starts").over(
        chain.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.col("_total") - F.col("_starts")
    tail = tail.withColumn("_base", base).withColumn("_v", F.when(
        F.col("_lastval").isNotNull(),
        F.struct((base + F.col("_lastval._seg")).alias("s"), F.col(f"_lastval.{value}").alias("v"))))
    tail = tail.withColumn("_in", F.last("_v", ignorenulls=True).over(
        chain.rowsBetween(Window.unboundedPreceding, -1)))
    carried = tail.select(key, "_b", "_base", "_in")
    t = t.join(carried, [key, "_b"])
    session = F.col("_base") + F.col("_seg")
    inherited = F.coalesce("_local", F.when(
        (F.col("_seg") == 0) & (F.col("_in.s") == F.col("_base")), F.col("_in.v")))
    return t.withColumns({"session_no": session, "inherited": inherited}).drop(
        "_b", "_prev", "_before", "_new", "_seg", "_local", "_base", "_in")


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 5
                    ) -> DataFrame:
    """Events of the same key in the trailing window, this one included, and a flag from `limit` on.

    Every event is written to its own and the next time bucket of window length, so a window inside
    (key, bucket) sees all it needs."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    e = events.withColumn("_us", us).withColumn("_home", F.floor(F.col("_us") / width))
    both = e.withColumn("_b", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-width, 0)
    return (both.withColumn("attempts", F.count("*").over(w)).filter("_b = _home")
            .withColumn("alert", F.col("attempts") >= limit).drop("_us", "_home", "_b"))

"""Debounced file events: of a run of events on a path, each less than the gap after the one before, the last counts.

In batch the runs are gaps found by windows; in a stream they are session windows. A stream needs a watermark: events
that come later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Quiet times before a re-parse and before an analysis.
WATCH_MS, ANALYSIS_MS = 500, 5_000


def debounce_batch(events: DataFrame, seconds: float) -> DataFrame:
    """(path, type, ts, merged) of events (path, type, ts, seq): one row for each run."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 1e6
    runs = events.withColumn("_new", F.when(gap < seconds, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    last = F.max(F.struct("ts", "seq", "type"))
    return runs.groupBy("path", "_run").agg(last.alias("x"), F.count("*").alias("merged")).select("path", F.col("x.type").alias("type"), F.col("x.ts").alias("ts"), "merged")


def debounce_stream(events: DataFrame, gap: str = f"{WATCH_MS} milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """The same over a stream of (path, type, ts): (path, type, ts, merged), one row once a run is over."""
    runs = events.withWatermark("ts", watermark).groupBy("path", F.session_window("ts", gap).alias("w"))
    return runs.agg(F.max_by("type", "ts").alias("type"), F.max("ts").alias("ts"), F.count("*").alias("merged")).drop("w")

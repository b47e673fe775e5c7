"""Queries that replay a table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..streaming.timers import OUT, PROVIDER, debounce_timers
from . import scratch
from .queries_values import DEBOUNCED
from .roster import query
from .testgraph import Tables

SHAPE = "path string, type string, ts timestamp, seq long"


def _replayed(t: Tables, events: DataFrame, gap: float) -> DataFrame:
    """The runs of ``events`` read as a stream that stops half-way and is started again from its checkpoint."""
    base = scratch.new_path(t.spark, "replay")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    parts = [events.where(F.col("ts") <= F.lit(lo) + (F.lit(hi) - F.lit(lo)) / 2), events.where(F.col("ts") > F.lit(lo) + (F.lit(hi) - F.lit(lo)) / 2)]
    end = t.spark.range(1).select(F.lit("~").alias("path"), F.lit("end").alias("type"), (F.lit(hi) + F.expr("interval 100 days")).alias("ts"), F.lit(0).cast("long").alias("seq"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, PROVIDER)
    try:
        for rows in (*parts, end):
            rows.coalesce(4).write.mode("append").parquet(f"{base}/events")
            stream = t.spark.readStream.schema(SHAPE).parquet(f"{base}/events")
            out = debounce_timers(stream, gap, "1 second").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(key, before) if before else t.spark.conf.unset(key)
    return t.spark.read.schema(OUT).parquet(f"{base}/out").where("path <> '~'")


@query(DEBOUNCED)
def debounce_by_timers(t: Tables):
    e = t.table("events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"))
    return _replayed(t, e, 6 * 3600).select(F.col("path").cast("long").alias("user_id"), "merged", "type")

"""A result cache with a time to live: as a table of entries, and for a service's results."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Seconds that a result of each kind lives.
TTL = {"security": 300, "complexity": 3600, "refactoring": 3600, "dataflow": 600, "impact": 300, "summary": 60}


def entry_key(kind: str, **parameters) -> str:
    """Kind and all parameters, so that results for other thresholds or depths aren't mixed up."""
    import json

    return f"{kind}:{json.dumps(parameters, sort_keys=True)}"


class ResultCache:
    """Results by kind and parameters, each for its kind's time to live; they are lazy DataFrames and cost no memory."""

    def __init__(self, spark: SparkSession, clock: Callable[[], float] = time.time):
        self.spark, self.clock = spark, clock
        self._held: dict[str, tuple[str, float, int, object]] = {}

    def get(self, kind: str, **parameters):
        found = self._held.get(entry_key(kind, **parameters))
        return found[3] if found and found[1] + found[2] > self.clock() else None

    def set(self, kind: str, result, **parameters):
        self._held[entry_key(kind, **parameters)] = (kind, self.clock(), TTL.get(kind, 300), result)
        return result

    def of(self, kind: str, make: Callable[[], object], **parameters):
        """The live result, or a new one that is kept."""
        found = self.get(kind, **parameters)
        return self.set(kind, make(), **parameters) if found is None else found

    def invalidate(self, kind: str | None = None) -> int:
        gone = [k for k, v in self._held.items() if kind is None or v[0] == kind]
        for k in gone:
            del self._held[k]
        return len(gone)

    def stats(self) -> DataFrame:
        rows = [(k, datetime.fromtimestamp(at, timezone.utc), ttl) for k, at, ttl, _ in self._held.values()]
        entries = self.spark.createDataFrame(rows, "type string, created timestamp, ttl int")
        return stats(entries, datetime.fromtimestamp(self.clock(), timezone.utc))


def live(entries: DataFrame, now) -> DataFrame:
    """Entries (type, created, ttl in seconds) that haven't expired."""
    return entries.where(_expires() > F.lit(now))


def invalidate(entries: DataFrame, kind: str | None = None) -> DataFrame:
    return entries.where(F.col("type") != kind) if kind else entries.where(F.lit(False))


def stats(entries: DataFrame, now) -> DataFrame:
    return entries.groupBy("type").agg(F.count("*").alias("entries"), F.count_if(_expires() > F.lit(now)).alias("live"))


def _expires():
    return F.timestamp_add("SECOND", F.col("ttl").cast("int"), F.col("created"))

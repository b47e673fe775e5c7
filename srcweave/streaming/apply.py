"""File events applied to a graph as a stream, and fan-out of what changed.

A stream can't see deletions in a folder, so events come as a log (path, type add|change|unlink, ts). After the
debounce each micro-batch parses the files that came or changed, drops those that went, resolves names over the whole
snapshot, and writes the next one beside the last. A version counts once its number has been added to the list of
complete ones, a single file that appears at once; nothing is overwritten, so readers see whole snapshots, and a batch
that is run again finds its version there and leaves it. Parsing costs what changed, resolution what the project has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import Snapshot, reindex
from ..sources.files import IGNORED
from ..functions.values import matches_any
from .debounce import ANALYSIS_MS, debounce_stream

EVENT = "path string, type string, ts timestamp"
Sink = Callable[[DataFrame, int], None]


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON-lines files that arrive in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def relevant(events: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    return events.where(~matches_any(F.col("path"), ignored))


class SnapshotStore:
    """Snapshots below a folder, numbered; ``complete`` lists those that can be read."""

    def __init__(self, spark: SparkSession, folder: str, root: str = "", project: str | None = None):
        self.spark, self.folder, self.root, self.project = spark, folder.rstrip("/"), root, project

    def write(self, snapshot: Snapshot, version: int) -> None:
        snapshot.save(f"{self.folder}/v{version}")
        done = self.spark.createDataFrame([(version,)], "version long")
        done.coalesce(1).write.mode("append").parquet(f"{self.folder}/complete")

    def version(self) -> int:
        return self.spark.read.schema("version long").parquet(f"{self.folder}/complete").agg(F.max("version")).first()[0]

    def read(self) -> Snapshot:
        return Snapshot.load(self.spark, f"{self.folder}/v{self.version()}", self.root, self.project)


def apply_events(store: SnapshotStore, events: DataFrame, contents: DataFrame, version: int) -> DataFrame:
    """Apply debounced events (path, type) with files' contents (path, content, modified); returns the change messages."""
    if store.version() < version:
        came = events.where("type <> 'unlink'").select("path").distinct()
        gone = events.where("type = 'unlink'").select("path").distinct()
        store.write(reindex(store.read(), contents.join(came, "path", "left_semi"), gone), version)
    kind = F.when(F.col("type") == "add", "file-added").when(F.col("type") == "change", "file-changed").otherwise("file-removed")
    return events.select(kind.alias("type"), "path").unionByName(events.sparkSession.createDataFrame([("graph-updated", None)], "type string, path string"))


def run(events: DataFrame, store: SnapshotStore, contents: Callable[[DataFrame], DataFrame], checkpoint: str, sinks: tuple[Sink, ...] = (), gap: str = "500 milliseconds", available_now: bool = False):
    """Start the stream: debounce, apply, hand the messages to every sink. contents: paths to rows of files."""

    def batch(df: DataFrame, number: int) -> None:
        ready = df.select("path", "type").persist()
        try:
            if not ready.isEmpty():
                messages = apply_events(store, ready, contents(ready.select("path")), number + 1)
                for sink in sinks:
                    sink(messages, number)
        finally:
            ready.unpersist()

    out = debounce_stream(relevant(events), gap).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="1 second")).start()


def run_analyses(events: DataFrame, job: Callable[[int], None], checkpoint: str, gap: str = f"{ANALYSIS_MS} milliseconds", available_now: bool = False):
    """Start the stream that calls ``job`` once changes have been quiet for the gap: what follows an ingestion."""
    out = debounce_stream(relevant(events), gap).writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else job(n)).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="1 second")).start()


def run_schedule(spark: SparkSession, job: Callable[[int], None], milliseconds: int, checkpoint: str):
    """Start a stream that calls ``job`` at every interval (see ``service.interval_of`` for schedules)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: job(n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{milliseconds} milliseconds").start()

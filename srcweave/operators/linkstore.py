"""References between files, kept up to date at the cost of what changes.

Files define names and refer to names; an edge leads from a file that refers to a name to each that defines it. The store
holds signed rows in segments: a change set writes what its files lose (-n) and gain (+n), and the edges that this makes
or breaks. These follow from the change alone: with R and D for what is there and r and d for the change, the edges'
change is r D + R d + r d, and of R and D only the rows of the change's names are read, by way of a copy in buckets of
names; what the files had is read from a copy in buckets of files. A segment counts once its record is written, and
``compact`` puts one in place of all. So bytes written grow with the change and its edges, not with the store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import scratch

BUCKETS = 64
ROW = "file string, name string, kind string, n long"
EDGE = "src string, dst string, name string, n long"


def _bucket(c: str) -> Column:
    return (F.crc32(F.col(c).cast("binary")) % BUCKETS).cast("int")


class LinkStore:
    """Rows (file, name, kind: def or ref, n: how often) and edges (src, dst, name, n) below a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        records = [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/records").collect()]
        gone = {x for r in records for x in r["replaces"]}
        return sorted(r["segment"] for r in records if r["segment"] not in gone)

    def _read(self, table: str, schema: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment string, bucket int")
        return self.spark.read.schema(f"{schema}, segment string, bucket int").option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/segment={s}" for s in segments])

    def _rows(self, by: str, keys: DataFrame) -> DataFrame:
        """What is there of some files or names (one column of distinct keys): other buckets aren't opened."""
        keys = keys.withColumn("bucket", _bucket(by))
        some = [r[0] for r in keys.select("bucket").distinct().collect()]  # 64 at most
        rows = self._read(f"by_{by}", ROW, self.segments()).where(F.col("bucket").isin(some)).join(keys, ["bucket", by], "left_semi")
        return rows.groupBy("file", "name", "kind").agg(F.sum("n").alias("n")).where("n <> 0")

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """A change set: all rows (file, name, kind, n) of the files that came or changed, and files (file) that went, whose
        rows go. Returns the number of rows written. A file without rows that should lose its old ones goes in ``removed``."""
        rows = changed.where("file is not null and name is not null").groupBy("file", "name", "kind").agg(F.sum("n").alias("n"))
        rows = scratch.materialize(rows, "change")
        files = rows.select("file") if removed is None else rows.select("file").unionAll(removed.select("file"))
        old = self._rows("file", scratch.materialize(files.distinct(), "files"))
        delta = rows.unionByName(old.withColumn("n", -F.col("n"))).groupBy("file", "name", "kind").agg(F.sum("n").alias("n")).where("n <> 0")
        delta = scratch.materialize(delta, "delta")
        there = scratch.materialize(self._rows("name", delta.select("name").distinct()), "there")
        return self._write(delta, self._edges(delta, there), [])

    @staticmethod
    def _edges(delta: DataFrame, there: DataFrame) -> DataFrame:
        """The edges' change: new references to old and new definitions, old references to new definitions."""
        tasks = scratch.parts(delta.sparkSession)
        every = there.withColumn("new", F.lit(False)).unionByName(delta.withColumn("new", F.lit(True))).repartition(tasks, "name")
        end = lambda kind, c: every.where(F.col("kind") == kind).select("name", F.col("file").alias(c), F.col("n").alias(f"n_{c}"), F.col("new").alias(f"new_{c}"))
        both = end("ref", "src").join(end("def", "dst"), "name").where("new_src or new_dst")  # a name's pairs are summed where they are made
        return both.groupBy("src", "dst", "name").agg(F.sum(F.col("n_src") * F.col("n_dst")).alias("n")).where("n <> 0")

    def _write(self, rows: DataFrame, edges: DataFrame, replaces: list[str]) -> int:
        segment, written = uuid.uuid4().hex[:12], 0
        for table, schema, df, key in (("by_file", ROW, rows, "file"), ("by_name", ROW, rows, "name"), ("edges", EDGE, edges, None)):
            if key:
                df = df.withColumn("bucket", _bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key)
            out = df.write.option("compression", "zstd")
            (out.partitionBy("bucket") if key else out).parquet(f"{self.path}/{table}/segment={segment}")  # edges are only read whole
            written += self._read(table, schema, [segment]).count()
        scratch.write_text(self.spark, f"{self.path}/records/{segment}.json", json.dumps({"segment": segment, "replaces": replaces}))
        return written

    def rows(self) -> DataFrame:
        return self._read("by_file", ROW, self.segments()).groupBy("file", "name", "kind").agg(F.sum("n").alias("n")).where("n <> 0")

    def edges(self) -> DataFrame:
        segments = self.segments()
        rows = self._read("edges", EDGE, segments)
        if len(segments) == 1:  # an edge is there once in a segment
            return rows.select("src", "dst", "name", "n")
        return rows.groupBy("src", "dst", "name").agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> int:
        """One segment in place of all."""
        return self._write(self.rows(), self.edges(), self.segments())

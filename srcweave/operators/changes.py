"""Change and rename detection between a stored and a current file listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import scratch


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def detect_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, type, hash, previous_hash) of listings (path, hash): added, modified, deleted or unchanged."""
    a, b = stored.select("path", F.col("hash").alias("previous_hash")), current.select("path", "hash")
    out = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "path", "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("hash").eqNullSafe(F.col("previous_hash")), "modified").otherwise("unchanged")
    return out.select("path", kind.alias("type"), "hash", "previous_hash")


HOT = 100_000  # rows of one hash that are numbered in one task; of more, in several


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (_h, path) with _n, the place of each path among those of its hash.

    A hash that very many files share (empty files) is dealt by ranges of paths; each task numbers its own and adds how
    many the ranges before it have.
    """
    w = Window.partitionBy("_h").orderBy("path")
    hot, n = scratch.counted(rows.groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("_h"), "hot")
    if not n:
        return rows.withColumn("_n", F.row_number().over(w))
    hot = F.broadcast(hot)  # one row for HOT rows of the listing at most
    dealt = scratch.materialize(rows.join(hot, "_h", "left_semi").repartitionByRange("_h", "path").withColumn("_p", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("_h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_h", "_p").agg(F.count("*").alias("n")).select("_h", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_h", "_p").orderBy("path"))).join(base, ["_h", "_p"])
    cold = rows.join(hot, "_h", "left_anti").withColumn("_n", F.row_number().over(w).cast("long"))
    return cold.unionByName(own.select("_h", "path", (F.col("_n") + F.col("base")).alias("_n")))


def match_renames(changes: DataFrame) -> DataFrame:
    """Changes with deleted and added files of equal hash matched one to one, in order of their paths, as renamed."""
    gone = _numbered(changes.where("type = 'deleted'").select(F.col("previous_hash").alias("_h"), "path"))
    came = _numbered(changes.where("type = 'added'").select(F.col("hash").alias("_h"), "path"))
    pairs = gone.withColumnRenamed("path", "old_path").join(came.withColumnRenamed("path", "new_path"), ["_h", "_n"])
    renamed = pairs.select(F.col("new_path").alias("path"), F.lit("renamed").alias("type"), F.col("_h").alias("hash"), F.col("_h").alias("previous_hash"), "old_path")
    used = pairs.select(F.col("old_path").alias("path"), F.lit("deleted").alias("type")).unionAll(pairs.select(F.col("new_path").alias("path"), F.lit("added").alias("type")))
    rest = changes.join(used, ["path", "type"], "left_anti").select("path", "type", "hash", "previous_hash").withColumn("old_path", F.lit(None).cast("string"))
    return rest.unionByName(renamed)


def summary(changes: DataFrame) -> DataFrame:
    kinds = ("added", "modified", "deleted", "renamed", "unchanged")
    return changes.agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == k).alias(k) for k in kinds], F.count_if(F.col("type").isin("added", "modified", "renamed")).alias("to_process"))


def recent(commits: DataFrame, limit: int, date: str = "date", key: str = "id") -> DataFrame:
    """The last commits by date, the least id first among equal dates."""
    return commits.orderBy(F.desc(date), key).limit(limit)

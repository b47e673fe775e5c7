"""Tables that cut lineage: written to the shared folder named by ``spark.checkpoint.dir`` and read back.

They stay for the session, as results are lazy and read them; ``clean`` deletes what the session has written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

PACKED = 40.0
PART_BYTES = 4 << 20
_FIRST, _OURS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.srcweave.initialPartitionNum"

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_named: dict[str, list[str]] = {}
_hooks: list[Callable[[], object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="srcweave-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def on_clean(forget: Callable[[], object]) -> None:
    """Call ``forget`` whenever tables are deleted: for what keeps references to them."""
    _hooks.append(forget)


def clean(spark: SparkSession) -> int:
    """Delete every table that this session has written here, those named in its catalog too; results that still read
    them can't be used any more, and what is kept for later queries is made anew."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for forget in _hooks:
        forget()
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def named(spark: SparkSession, table: str) -> str:
    """Remember a catalog table of this session, for ``clean``."""
    _named.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file through the session's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back: what follows doesn't recompute it, and a lost executor loses nothing."""
    return counted(df, name, by, False)[0]


def by_label(pieces: dict[str, DataFrame], name: str) -> DataFrame:
    """The same of one piece for each label, as (..., label): each is written to its folder as it comes, so that no task sorts
    its rows by label."""
    first = next(iter(pieces.values()))
    spark, schema = first.sparkSession, first.schema
    path = new_path(spark, name)
    for label, df in pieces.items():
        df.select(*schema.names).write.option("compression", "zstd").parquet(f"{path}/label={quote(label, safe='')}")
    return spark.read.schema(StructType([*schema, StructField("label", StringType())])).parquet(path)


def true_sizes(spark: SparkSession) -> None:
    """Let plans take a stored table for ``PACKED`` times its files unless the session says otherwise: columns of ids in
    order pack that well, and a side that looks small by its files alone would be collected on the driver to be broadcast.
    Sides that are small when they have been shuffled are still broadcast, by their measured size. For the same reason a task
    gets a quarter of Spark's defaults of shuffled and stored bytes, where the session says nothing else."""
    for key, default, size in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", 64 << 20, "16m"), ("spark.sql.files.maxPartitionBytes", 128 << 20, "32m")):
        if spark.conf.get(key) == f"{default}b":
            spark.conf.set(key, size)
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1:
        spark.conf.set(key, str(PACKED))


def parts_by_input(spark: SparkSession, paths: list[str]) -> None:
    """Let a shuffle begin with a part for every ``PART_BYTES`` of these files where that is more than the session's number of
    parts and the session names no first number itself. With one number for any input, what a task sorts and groups would grow
    as the input does; adaptive execution puts the parts together that turn out small."""
    if spark.conf.get(_FIRST, None) != spark.conf.get(_OURS, None):
        return
    size, conf = 0, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        size += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    n = -(-size // PART_BYTES)
    for key in (_FIRST, _OURS):
        if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(key, str(n))
        else:
            spark.conf.unset(key)


def parts(spark: SparkSession) -> int:
    """How many parts a shuffle begins with."""
    return int(spark.conf.get(_FIRST, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def counted(df: DataFrame, name: str, by: tuple[str, ...] = (), count: bool = True) -> tuple[DataFrame, int]:
    """The same, partitioned by some columns; and the number of rows, counted while they are written."""
    spark = df.sparkSession
    path, seen = new_path(spark, name), Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), seen.get["n"] if count else -1

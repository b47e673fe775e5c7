"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get the numbers 0 .. N-1 in the order of (id, text checksum, size); a keyed Feistel network permutes the smallest
domain of 4^b numbers that holds N, and a number that leaves 0 .. N-1 walks on along its cycle until it is back inside.
The permuted number p gives shard p mod S and slot p div S: shards differ by at most one row (law ``rows``), slots are
gapless, and either can be computed for any row number without the others. The seed fixes the shuffle.

Row numbers need no global sort on one task: rows are dealt by ranges, counted by range, and each range starts where
the ones before end. What is summed on one task is one count per range. Rows that are equal in all three columns may
exchange numbers, which changes no result; a final random column keeps even such rows from meeting in one range.

Cases: a null id sorts first and is permuted like any; a null or empty text has no bytes, size 8 and checksum 0;
repeated rows get a place each; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import scratch
from .textkit import mix

SHARDS = 24
SEED = 20_240_229
ROUNDS = 6
U = np.uint64


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each of the numbers x in a keyed permutation of 0 .. n-1."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    mask = U((1 << half) - 1)
    out = np.asarray(x).astype(U)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> U(half), v & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (mix(right + U(k << 40), seed + k) & mask)
        v = (left << U(half)) | right
        out[todo] = v
        todo = todo[v >= U(n)]
    return out.astype(np.int64)


def row_numbers(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(df with ``row_number`` from 0 in the given order, number of rows)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_tie", F.rand(1)).repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    dealt = scratch.materialize(dealt.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "rows")  # ranges come from a sample: written once
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_from", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_from"])
    total = counts.agg(F.sum("_n")).first()[0] or 0
    starts = F.broadcast(counts.select("_part", "_from"))  # one row per range
    numbered = dealt.join(starts, "_part").withColumn("row_number", F.col("_from") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_id", "_part", "_from"), total


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row (doc_id, size, text_crc32, row_number, shard, slot)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, total = row_numbers(rows, "doc_id", "text_crc32", "size")

    def place(it):
        for b in it:
            p = permute(b.column(3).to_numpy(zero_copy_only=False), total, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*b.schema.names, "shard", "slot"])

    rows = numbered.select("doc_id", "size", "text_crc32", "row_number")
    return rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")


def op3_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

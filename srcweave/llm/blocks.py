"""Blocks of documents, and the exchange of compact per-block summaries for replies.

A *block* is one row holding a few MB of whole documents. A block sends, for each *slice* of a hash space, one
binary with sorted values; the task of a slice merges what all blocks sent and replies to each block with one bit
(or one byte) per value sent. Each block sends a value once, so no key however frequent makes a slice uneven, and
slices are as many as the input asks for, so each stays small at any size. Blocks are written once, bucketed by
block: replies travel to the blocks, texts are not shuffled at all.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..plans import scratch
from .textkit import buffers

BLOCK_BYTES = 8 << 20
SLICE_VALUES = 1 << 20
REPLY = "block long, kind int, slice int, data binary"
U = np.uint64


def _pack(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[pa.RecordBatch] = []

    def row():
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.num_rows
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.chunk(0)) for c in rows.columns]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq], pa.int64()), *lists], ["block", *rows.schema.names])

    for b in it:
        _, off = buffers(b.column("text"))
        off = off + 16 * np.arange(len(off))  # so that empty texts count too
        lo = 0
        while lo < b.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit - size, "right"))), b.num_rows)
            held.append(b.slice(lo, hi - lo))
            size += int(off[hi] - off[lo])
            lo = hi
            if size >= limit:
                yield row()
                held, size, seq = [], 0, seq + 1
    if held:
        yield row()


def pack(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(blocks table (block, ids, texts, and each column of keep as an array), bucketed by block; bytes of all texts)."""
    more = [F.col(c).alias(f"x{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = "block long, " + ", ".join(f"{c} array<{t}>" for c, t in rows.dtypes)
    packed = rows.mapInArrow(lambda it: _pack(it, block_bytes), schema)
    return store(packed, size, block_bytes), size


def store(rows: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with a column block, written bucketed by it: the number of buckets depends on the corpus's bytes alone."""
    spark = rows.sparkSession
    n = max(math.ceil(size / (2 * block_bytes)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = scratch.named(spark, f"blocks_{uuid.uuid4().hex[:12]}")
    rows.write.format("parquet").option("compression", "zstd").option("path", scratch.new_path(spark, name)).bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


def with_replies(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Blocks with the list of the replies they got."""
    got = replies[0]
    for r in replies[1:]:
        got = got.unionByName(r)
    got = got.groupBy("block").agg(F.collect_list(F.struct("kind", "slice", "data")).alias("replies"))
    return blocks.join(got.hint("shuffle_hash"), "block", "left")


def ask(blocks: DataFrame, fn: Callable[[dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (slice, block, data) that ``fn`` makes of each block, given as a dict of its columns."""

    def run(it):
        for b in it:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                sent = list(fn(row(one)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in sent], pa.int32()), pa.array([one.column("block")[0].as_py()] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())],
                    ["slice", "block", "data"],
                )

    return blocks.mapInArrow(run, "slice int, block long, data binary")


def row(one: pa.RecordBatch) -> dict:
    """A block as {block, ids, texts and kept columns: Arrow arrays, replies: {(kind, slice): data}}."""
    kept = [one.column(c).flatten() for c in one.schema.names if c[0] == "x"]
    out = {"block": one.column("block")[0].as_py(), "ids": one.column("id").flatten(), "texts": one.column("text").flatten(), "kept": kept, "replies": {}}
    if "replies" in one.schema.names:
        out["replies"] = {(r["kind"], r["slice"]): r["data"] for r in (one.column("replies")[0].as_py() or [])}
    return out


def merge(asked: DataFrame, kind: int, fn: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Replies: ``fn`` gets what the blocks sent to a slice, in the order of the blocks, and returns a reply for each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        data = fn(table.column("data").to_pylist())
        n = table.num_rows
        return pa.table([table.column("block"), pa.array([kind] * n, pa.int32()), table.column("slice"), pa.array(data, pa.binary())], ["block", "kind", "slice", "data"])

    return asked.groupBy("slice").applyInArrow(run, REPLY)


def encode(values: np.ndarray) -> bytes:
    """Sorted unsigned values, as gaps by byte planes, compressed."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(len(gaps), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def decode(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind), dtype=kind)


def bits(flags: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(flags).tobytes(), 1)


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)


def framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and whether each occurs twice or more."""
    v = np.sort(values)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return v[at], np.diff(np.append(at, len(v))) > 1


def cuts(slices: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to) for each run of a sorted array of slice numbers."""
    if len(slices):
        at = np.append(np.flatnonzero(np.diff(slices, prepend=slices[0] - 1)), len(slices))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(slices[a]), a, b

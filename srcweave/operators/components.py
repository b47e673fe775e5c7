"""Connected components of an undirected graph by alternating large and small stars.

Each step replaces the edge list by one in which every vertex points nearer to its component's least id, and a few
rounds (about the logarithm of the longest path) bring it to a star around that id. A step is one aggregation of
minima with a map-side part and one join with one row per vertex on the other side, which adaptive execution can
split when a hub has many edges. Edges are written to the shared checkpoint folder after every round. They are counted
while the first step writes them: ``LOCAL_EDGES`` or fewer, a few MB, are finished by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans import scratch

LOCAL_EDGES = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    up = down.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return up.unionAll(least.select("src", F.col("m").alias("dst"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _finish(batches):
    """(id, component) of a few edges: roots hook onto lesser roots and paths are halved until no edge joins two."""
    edges = pa.Table.from_batches(b) if (b := list(batches)) else None
    if edges is None or not edges.num_rows:
        return
    src, dst = (edges.column(c).to_numpy() for c in ("src", "dst"))
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    kind = edges.schema.field("src").type
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[root], kind)], ["id", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every vertex with an edge to another; component is the least id that it reaches.

    Self-loops and nulls are dropped, so isolated vertices don't appear. An empty table gives an empty result.
    """
    now = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    now, n = scratch.counted(_small_star(now), "edges")
    if n <= local_edges:
        kind = now.schema["src"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_finish, f"id {kind}, component {kind}")
    seen = _sum(now)
    while seen[0]:
        now = scratch.materialize(_small_star(_large_star(now)), "edges")
        last, seen = seen, _sum(now)
        if last == seen:
            break
    ids = now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return ids.unionAll(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())

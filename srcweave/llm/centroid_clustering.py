"""Centroid clustering: Lloyd's rounds over integer vectors, assigned by two trees at once.

Vectors are packed into blocks of ``BLOCK`` rows where they lie, without a shuffle. Each block builds a cover tree over
its distinct vectors once (nodes halve the radius of the node above, their centres are further than that apart, the
first child keeps its parent's centre) and is written with it. Each round builds a cover tree over the centroids, and
every block walks down both trees together: a pair of nodes goes when the least distance between them exceeds the
largest distance from the vectors' node to some centroid of another pair. A node of vectors that is left with one
centroid goes to it whole, by its stored sums; pairs of leaves are compared exactly, in whole numbers. Bounds are
floats with a margin, so they never decide what a whole number should.

A block hands on one row of sums for each centroid, so a round shuffles centroids x blocks rows and brings ``k`` of
them to the driver (k is a parameter). Copies of a vector are one point of their block's tree, however many.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out; components
beyond +-2^27 after scaling count as that, as their distance wouldn't fit a long; an inertia beyond a long is null; null
ids hash as an empty one; rows of equal ids are a vector each, and the first by components comes first among equal
hashes; fewer vectors than k give as many centroids; without any the result is empty. Only the two named columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans import scratch
from . import blocks as B

K = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
BLOCK = 4096
LEAF = 24
MOST = 1 << 27


@dataclass
class CoverTree:
    """Nodes in breadth-first order, a node's children and points side by side; ``order`` lists the points that way."""

    order: np.ndarray
    centre: np.ndarray  # a point
    radius: np.ndarray
    first: np.ndarray  # range of points in ``order``
    last: np.ndarray
    child: np.ndarray  # range of children, empty for a leaf
    end: np.ndarray

    def dump(self) -> bytes:
        return B.framed(*[getattr(self, f.name).tobytes() for f in fields(self)])

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        kinds = (np.int32, np.int32, np.float64, np.int32, np.int32, np.int32, np.int32)
        return cls(*[np.frombuffer(x, k) for x, k in zip(B.parts(data), kinds, strict=True)])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, in whole numbers."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree over distinct points. A node is a leaf with ``leaf`` points or fewer, or (leaves of one point apart)
    where halving its radius would leave nearly every point on its own."""
    order = np.arange(len(x))
    rows = [[0, np.sqrt(squares(x, x[0]).max()), 0, len(x), 0, 0]]  # centre, radius, first, last, child, end
    at = 0
    while at < len(rows):
        centre, radius, first, last, _, _ = rows[at]
        if last - first > leaf and radius > 0:
            rest, parts = order[first:last], []
            while len(rest) and (leaf == 1 or len(parts) <= (last - first) // 2):
                c = centre if not parts else int(rest[0])
                d = np.sqrt(squares(x[rest], x[c]))
                near = d <= radius / 2
                parts.append((c, float(d[near].max()), rest[near]))
                rest = rest[~near]
            if not len(rest):
                rows[at][4:] = len(rows), len(rows) + len(parts)
                order[first:last] = np.concatenate([p for *_, p in parts])
                for c, r, p in parts:
                    rows.append([c, r, first, first + len(p), 0, 0])
                    first += len(p)
        at += 1
    columns = list(zip(*rows, strict=True))
    ints = lambda k: np.array(columns[k], np.int32)
    return CoverTree(order.astype(np.int32), ints(0), np.array(columns[1], float), ints(2), ints(3), ints(4), ints(5))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) for every member of some ranges."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def dual_tree(x: np.ndarray, tx: CoverTree, c: np.ndarray, tc: CoverTree) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(nodes that went to a centroid whole: (first, last, centroid), owner of each place of ``tx.order``).

    ``c`` are distinct centroids in the order of their numbers; equal distances go to the first.
    """
    owner, whole = np.full(len(x), -1, np.int32), []
    nx, nc = np.zeros(1, np.int64), np.zeros(1, np.int64)
    single = tc.last - tc.first == 1
    while len(nx):
        d = np.sqrt(squares(x[tx.centre[nx]], c[tc.centre[nc]]))
        rx, rc = tx.radius[nx], tc.radius[nc]
        starts = np.flatnonzero(np.diff(nx, prepend=-1))
        run = np.cumsum(np.diff(nx, prepend=-1) != 0) - 1
        upper = (np.minimum.reduceat(d, starts) + rx[starts])[run]  # a node's centre is a centroid
        keep = d - rx - rc <= upper + 1e-9 * (1 + upper + d)
        nx, nc, rx, rc = nx[keep], nc[keep], rx[keep], rc[keep]
        starts = np.flatnonzero(np.diff(nx, prepend=-1))
        n = np.diff(np.append(starts, len(nx)))
        run = np.repeat(np.arange(len(starts)), n)
        leaf_x = tx.end[nx] == tx.child[nx]
        lone = ((n == 1)[run]) & single[nc]
        for a, o in zip(nx[lone].tolist(), tc.order[tc.first[nc[lone]]].tolist(), strict=True):
            whole.append((int(tx.first[a]), int(tx.last[a]), o))
            owner[tx.first[a] : tx.last[a]] = o
        down_c = (tc.end[nc] > tc.child[nc]) & ((rc >= rx) | leaf_x) & ~lone
        waits = np.zeros(len(starts), bool)
        np.logical_or.at(waits, run, down_c)
        ready = leaf_x & ~waits[run] & ~lone
        if ready.any():
            _compare(x, tx, c, tc, nx[ready], nc[ready], owner, whole)
        down_x = ~leaf_x & ~waits[run] & ~lone
        stay = waits[run] & ~down_c
        oc, kc = _spread(tc.child[nc[down_c]], tc.end[nc[down_c]])
        ox, kx = _spread(tx.child[nx[down_x]], tx.end[nx[down_x]])
        nx, nc = np.concatenate([nx[stay], nx[down_c][oc], kx]), np.concatenate([nc[stay], kc, nc[down_x][ox]])
        by = np.lexsort((nc, nx))
        nx, nc = nx[by], nc[by]
    return whole, owner


def _compare(x: np.ndarray, tx: CoverTree, c: np.ndarray, tc: CoverTree, nx: np.ndarray, nc: np.ndarray, owner: np.ndarray, whole: list) -> None:
    """Pairs of leaves: every vector with every centroid that is left."""
    at = np.append(np.flatnonzero(np.diff(nx, prepend=-1)), len(nx))
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        first, last = int(tx.first[nx[a]]), int(tx.last[nx[a]])
        some = np.sort(np.concatenate([tc.order[tc.first[k] : tc.last[k]] for k in nc[a:z].tolist()]))
        d = squares(x[tx.order[first:last], None], c[None, some])
        owner[first:last] = some[np.argmin(d, axis=1)]
        whole.extend((first + i, first + i + 1, o) for i, o in enumerate(owner[first:last].tolist()))


@dataclass
class _Block:
    ids: pa.Array
    x: np.ndarray  # distinct vectors
    of: np.ndarray  # each row's vector
    tree: CoverTree

    def row(self) -> pa.RecordBatch:
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids)
        rest = [pa.array([b], pa.binary()) for b in (self.x.tobytes(), self.of.tobytes(), self.tree.dump())]
        return pa.RecordBatch.from_arrays([ids, *rest], ["ids", "x", "of", "tree"])

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Block]:
        for b in batches:
            for k in range(b.num_rows):
                x, of, tree = (b.column(c)[k].as_py() for c in ("x", "of", "tree"))
                yield cls(b.column("ids").slice(k, 1).flatten(), np.frombuffer(x, np.int64).reshape(-1, width), np.frombuffer(of, np.int32), CoverTree.load(tree))


_BLOCK = "ids array<long>, x binary, of binary, tree binary"


def _kept(b: pa.RecordBatch, width: int, scale: float) -> tuple[pa.Array, np.ndarray]:
    """(ids, whole-number vectors) of a batch's usable rows."""
    v = b.column("v")
    sizes = np.asarray(pc.list_value_length(v).fill_null(-1))
    at = np.flatnonzero(sizes == width)
    ids, v = b.column("id").take(pa.array(at)), v.take(pa.array(at)).flatten()
    x = v.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return ids.filter(pa.array(good)), np.clip(np.floor(scale * x[good]), -MOST, MOST).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], width: int, scale: float, size: int) -> Iterator[pa.RecordBatch]:
    ids, xs, n = [], [], 0

    def made():
        i, x = pa.concat_arrays(ids), np.concatenate(xs)
        for lo in range(0, len(x), size):
            own, of = np.unique(x[lo : lo + size], axis=0, return_inverse=True)
            yield _Block(i.slice(lo, size), own, of.reshape(-1).astype(np.int32), cover_tree(own)).row()

    for b in batches:
        i, x = _kept(b, width, scale)
        if len(x):
            ids, xs, n = [*ids, i], [*xs, x], n + len(x)
        if n >= size:
            yield from made()
            ids, xs, n = [], [], 0
    if n:
        yield from made()


def _starts(blocks: DataFrame, k: int, width: int, salt: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes."""

    def run(it):
        for b in _Block.each(it, width):
            h = [hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest() for i in b.ids.to_pylist()]
            at = sorted(range(len(h)), key=lambda r: (h[r], b.x[b.of[r]].tolist()))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([h[r] for r in at]), pa.array([b.x[b.of[r]].tolist() for r in at], pa.list_(pa.int64()))], ["h", "x"])

    return [r["x"] for r in blocks.mapInArrow(run, "h string, x array<long>").orderBy("h", "x").limit(k).collect()]


class _Centroids:
    """Centroids by number; equal ones are known by the first number."""

    def __init__(self, rows: list[list[int]]):
        x = np.array(rows, np.int64)
        _, at = np.unique(x, axis=0, return_index=True)
        self.number = np.sort(at).astype(np.int32)
        self.x = x[self.number]
        self.tree = cover_tree(self.x, 1)


def _sums(blocks: DataFrame, rows: list[list[int]], width: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid with vectors: (their number, their sum)."""
    c = _Centroids(rows)

    def run(it):
        for b in _Block.each(it, width):
            whole, _ = dual_tree(b.x, b.tree, c.x, c.tree)
            many = np.bincount(b.of, minlength=len(b.x))[b.tree.order]
            ahead = lambda v: np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(v, axis=0)])
            upto = ahead(np.column_stack([many, b.x[b.tree.order] * many[:, None]]))
            first, last, o = np.array(whole, np.int64).reshape(-1, 3).T
            total = np.zeros((len(c.x), width + 1), np.int64)
            np.add.at(total, o, upto[last] - upto[first])
            some = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(c.number[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["k", "v"])

    parts = blocks.select("x", "of", "tree", "ids").mapInArrow(run, "k int, v array<long>")
    sums = parts.groupBy("k").agg(*[F.sum(F.col("v")[i].cast("decimal(20,0)")).alias(f"v{i}") for i in range(width + 1)])
    return {r[0]: (int(r[1]), [int(s) for s in r[2:]]) for r in sums.collect()}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE, salt: str = "1:") -> DataFrame:
    """Per usable vector (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = scratch.materialize(rows.mapInArrow(lambda it: _packed(it, width, scale, BLOCK), _BLOCK), "vectors")
    now = _starts(blocks, k, width, salt)
    for _ in range(rounds if now else 0):
        got = _sums(blocks, now, width)
        now = [[s // got[i][0] for s in got[i][1]] if i in got else c for i, c in enumerate(now)]
    c = _Centroids(now) if now else None

    def run(it):
        for b in _Block.each(it, width):
            _, placed = dual_tree(b.x, b.tree, c.x, c.tree)
            owner = np.empty(len(b.x), np.int32)
            owner[b.tree.order] = placed
            own, d = c.number[owner][b.of], squares(b.x, c.x[owner])[b.of]
            yield pa.RecordBatch.from_arrays([b.ids, pa.array(own), pa.array(d)], ["vec_id", "cluster", "distance"])

    done = scratch.materialize(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows at most
    fits = lambda s: s if s < 1 << 63 else None
    told = {r["cluster"]: (fits(int(r["s"])), hashlib.sha256(",".join(map(str, now[r["cluster"]])).encode()).hexdigest()) for r in sums}
    of = lambda j, kind: F.element_at(F.create_map(*[F.lit(x).cast(t) for i, v in told.items() for x, t in ((i, "int"), (v[j], kind))]), F.col("cluster")) if told else F.lit(None).cast(kind)
    total = F.lit(fits(sum(int(r["s"]) for r in sums))).cast("long")
    return done.select("vec_id", "cluster", "distance", of(0, "long").alias("cluster_inertia"), total.alias("inertia"), of(1, "string").alias("centroid_sha256"))


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

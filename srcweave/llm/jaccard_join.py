"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Jaccard distance is a metric, so pivots can divide the documents into regions. In it almost all documents are at
distance 1 from any given document, so documents drawn as pivots would leave nearly everything in one region. The
first level's pivots are therefore single shingles, ordered by document frequency and hash: a document's cell is that
of its first shingle, and the triangle inequality bounds where a partner within the radius can be: two sets within
distance 0.2 share one of the first n/5 + 1 shingles of either. A document is replicated to the regions of just these
(its window), so every link lies inside some region. Inside regions, documents are pivots:

1. First the regions of each document's rarest shared shingles are taken, and each document is measured exactly
   against the pivot of most of them; what lies within the radius is merged. Documents that a pivot links are
   one component from then on and need no comparison with each other, so a group of copies of any size costs a
   few comparisons for each member, not one for each pair.
2. Then all regions are looked at, and those that hold more than one component go on: a round draws one more pivot in
   each, measures it against the documents outside its component, and regions that became one component drop out.
3. After ``ROUNDS`` rounds, or one that settled less than a tenth of the regions, those left over are cut into parts and join, but only pairs of different components,
   within the length and position bounds, and not set apart by the triangle inequality: by the
   distances to common pivots that differ by more than the radius, or by the numbers of shingles in ``CLASSES`` hash
   classes, which act as pivots too (in all classes together two sets share at most the sum of the smaller numbers).

Documents with equal sets count as one from the start (the one with the least id stands for them), and documents
whose window has no shingle in common with any other document leave at once. Frequencies come from an exchange of
blocks (see ``blocks``) and only order the shingles: they may overestimate, and the result doesn't depend on them.
Sets hold 48-bit hashes of the shingles that other documents have; sizes are those of the whole sets. Equal sets are
known by 128 bits and looked up once for each block, so copies of one text don't meet in one task.

Cases: documents without words have an empty set and no links; those with fewer than five words have their whole
sequence as the one shingle; repeated rows are equal sets; among equal ids each row keeps its own set; null ids never
stand for others; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..plans import scratch
from . import blocks as B
from .textkit import SPACED, distinct, grams, mix, words

SHINGLE = 5
ROUNDS = 3
FIRST = 8
CLASSES = 32  # hash classes of shingles, by which sets are told apart
BROADCAST_ROWS = 1_000_000
PIVOTS = 64
PART = 256  # documents of a crowded region that one part of it compares with all others
CELLS = 1 << 26
U = np.uint64
MAX_ID = np.iinfo(np.int64).max


class _Sets:
    """The shingle sets of a block's documents, end to end."""

    def __init__(self, block: dict, slices: int):
        w = words(block["texts"], SPACED, True)
        h, n = w.hashes(), w.counts
        g = {k: grams(h, k) for k in range(1, SHINGLE + 1)}
        sets = []
        for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            k = min(z - a, SHINGLE)
            sets.append(distinct(g[k][a : z - k + 1]) if k else np.empty(0, U))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.all = np.concatenate(sets) if sets else np.empty(0, U)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        x = mix(self.all, 3)
        self.cells = (x >> U(32)) % U(slices) * U(CELLS) + (x & U(CELLS - 1))
        at = np.minimum(self.first[:-1], max(len(self.all) - 1, 0))
        total = lambda seed: np.where(self.sizes > 0, np.add.reduceat(mix(self.all, seed), at), U(0)) if len(self.all) else np.zeros(len(sets), U)
        self.f1, self.f2 = mix(total(11) + self.sizes.astype(U)), total(12)
        ids = block["ids"]
        self.ids = ids.fill_null(MAX_ID).to_numpy(zero_copy_only=False) if ids.null_count else ids.to_numpy()

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """(documents in the order of their set's fingerprint and of the id, which of them begin a new set)."""
        order = np.lexsort((self.ids, self.f2, self.f1))
        order = order[self.sizes[order] > 0]
        a, b = self.f1[order], self.f2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, new


def _slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (((h >> U(33)) * U(slices)) >> U(31)).astype(np.int64)


def _send(block: dict, slices: int):
    s = _Sets(block, slices)
    cells, n = np.unique(s.cells, return_counts=True)
    n = np.minimum(n, 255).astype(np.uint8)
    for k, a, b in B.cuts((cells // U(CELLS)).astype(np.int64)):
        yield k, B.framed(b"cells", B.encode((cells[a:b] % U(CELLS)).astype(np.uint32)), zstandard.compress(n[a:b].tobytes(), 1))
    order, new = s.prints()
    first = order[new]
    for k, a, b in B.cuts(_slice_of(s.f1[first], slices)):
        d = first[a:b]
        yield slices + k, B.framed(b"sets", s.f1[d].tobytes(), s.f2[d].tobytes(), s.ids[d].tobytes())


def _merge(sent: list[bytes]) -> list[bytes]:
    got = [B.parts(x) for x in sent]
    if got[0][0] == b"cells":
        cells = [B.decode(x[1], np.uint32) for x in got]
        sizes = [len(c) for c in cells]
        n = np.concatenate([np.frombuffer(zstandard.decompress(x[2]), np.uint8) for x in got]).astype(np.int64)
        every = np.concatenate(cells)
        order = np.argsort(every)
        new = np.diff(every[order], prepend=np.uint32(0)) != 0
        new[:1] = True
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        level = np.empty(len(every), np.uint8)
        level[order] = np.log2(total).astype(np.uint8)[np.cumsum(new) - 1]
        return [zstandard.compress(x.tobytes(), 1) for x in np.split(level, np.cumsum(sizes)[:-1])]
    f1, f2, ids = (np.concatenate([np.frombuffer(x[k], t) for x in got]) for k, t in ((1, U), (2, U), (3, np.int64)))
    sizes = [len(x[1]) // 8 for x in got]
    order = np.lexsort((ids, f2, f1))
    first = np.empty(len(order), bool)
    new = np.ones(len(order), bool)
    new[1:] = (f1[order][1:] != f1[order][:-1]) | (f2[order][1:] != f2[order][:-1])
    first[order] = new
    return [B.bits(x) for x in np.split(first, np.cumsum(sizes)[:-1])]


_ROWS = "block long, place int, doc_id long, n long, print binary, key long, ids binary, counts array<smallint>, tokens array<long>, places array<int>"


def _rows(block: dict, slices: int) -> pa.RecordBatch:
    """Every document's size and set's fingerprint; sets and windows of those that stand for a set and may have partners."""
    s = _Sets(block, slices)
    by_cell = np.argsort(s.cells)
    new = np.diff(s.cells[by_cell], prepend=U(0)) != 0
    new[:1] = True
    cells = s.cells[by_cell][new]
    level = np.zeros(len(cells), np.uint8)
    for k, a, b in B.cuts((cells // U(CELLS)).astype(np.int64)):
        level[a:b] = np.frombuffer(zstandard.decompress(block["replies"][(0, k)]), np.uint8)
    of = np.empty(len(by_cell), np.int64)
    of[by_cell] = np.cumsum(new) - 1
    level = level[of]
    order, new = s.prints()
    first = order[new]
    stands = np.zeros(len(first), bool)
    for k, a, b in B.cuts(_slice_of(s.f1[first], slices)):
        stands[a:b] = B.flags(block["replies"][(0, slices + k)], b - a)
    sets: list = [None] * len(s.sizes)
    tokens: list = [None] * len(s.sizes)
    places: list = [None] * len(s.sizes)
    counts: list = [None] * len(s.sizes)
    for d in first[stands].tolist():
        a, z = s.first[d], s.first[d + 1]
        h, lv = s.all[a:z], level[a:z]
        rank = np.lexsort((h, lv))[: (z - a) // 5 + 1]
        shared = np.flatnonzero(lv[rank] > 0)
        if len(shared):
            sets[d] = B.encode(distinct(mix(h[lv > 0], 5) >> U(16)))
            if len(h) < 1 << 15:
                counts[d] = np.bincount((mix(h[lv > 0], 6) >> U(59)).astype(np.int64), minlength=CLASSES).astype(np.int16)
            tokens[d] = h[rank[shared]].view(np.int64)
            places[d] = shared.astype(np.int32)
    part, seq = divmod(block["block"], 1 << 32)
    place = np.arange(len(s.sizes))
    return pa.RecordBatch.from_arrays(
        [pa.array([block["block"]] * len(place), pa.int64()), pa.array(place, pa.int32()), block["ids"], pa.array(s.sizes), pa.array([x.tobytes() for x in np.stack([s.f1, s.f2], 1)] if len(place) else [], pa.binary()), pa.array((part << 40 | seq << 24) + place), pa.array(sets, pa.binary()), pa.array(counts, pa.list_(pa.int16())), pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
        [c.split()[0] for c in _ROWS.split(", ")],
    )


def _measure(it):
    """(a, b, common): numbers of common shingles."""
    for batch in it:
        common, last, x = [], None, None
        for p, q in zip(batch.column("set_a"), batch.column("set_b"), strict=True):  # one pair at a time: sets may be large
            p, q = p.as_py(), q.as_py()
            if q != last:
                last, x = q, B.decode(q, U)
            y = B.decode(p, U)
            k = np.searchsorted(x, y)
            common.append(int((x[np.minimum(k, len(x) - 1)] == y).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(common, pa.int64())], ["a", "b", "n_a", "n_b", "common"])


#: 100 * common >= 80 * union, in whole numbers.
LINKED = "9 * common >= 4 * (n_a + n_b)"
#: Bounds on a pair: sizes; what is left after a common token on either side; what the classes have in common at most.
SIZES = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"
POSSIBLE = f"{SIZES} and 9 * least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)"
CLASSED = "coalesce(9 * aggregate(zip_with(counts_a, counts_b, (x, y) -> least(x, y)), 0L, (s, x) -> s + x) >= 4 * (n_a + n_b), true)"


def _measured(pairs: DataFrame, stands: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) of the pairs (a, b) that neither sizes nor classes rule out.

    Sizes and class counts go first; whole sets are fetched only for the documents of the pairs that are left.
    """
    side = lambda df, x, *cols: df.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    some = pairs.join(side(stands, "a", "n", "counts"), "a").join(side(stands, "b", "n", "counts"), "b").where(f"{SIZES} and {CLASSED}")
    some = scratch.materialize(some.select("a", "b", "n_a", "n_b"), "pairs")
    need, many = scratch.counted(some.select(F.col("a").alias("key")).unionAll(some.select("b")).distinct(), "need")
    if many <= BROADCAST_ROWS:
        need = F.broadcast(need)
    sets = stands.select("key", "ids").join(need, "key", "left_semi")
    both = some.join(side(sets, "a", "ids"), "a").join(side(sets, "b", "ids"), "b").withColumnsRenamed({"ids_a": "set_a", "ids_b": "set_b"})
    both = both.select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(_measure, "a long, b long, n_a long, n_b long, common long")
    return scratch.materialize(both, "measured")


def _relabel(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """Labels after merging the components of linked pairs."""
    la, lb = labels.select(F.col("key").alias("a"), F.col("c").alias("src")), labels.select(F.col("key").alias("b"), F.col("c").alias("dst"))
    edges = linked.join(la, "a").join(lb, "b").select("src", "dst").where("src <> dst").distinct()
    merged = connected_components(edges).toDF("c", "to")
    return scratch.materialize(labels.join(merged, "c", "left").select("key", F.coalesce("to", "c").alias("c")), "labels")


def _components(table: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(every document's row, (key, c): the component's label for the sets that may have partners)."""
    spark = table.sparkSession
    slices = max(1, math.ceil(size / 6 / B.SLICE_VALUES))
    replies = B.merge(B.ask(table, lambda b: _send(b, slices)), 0, _merge)

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                yield _rows(B.row(batch.slice(k, 1)), slices)

    rows = scratch.materialize(B.with_replies(table, replies).mapInArrow(run, _ROWS), "sets")
    stands = rows.where("ids is not null")
    windows = stands.select("key", "n", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("at"))).alias("token", "at"))

    # first the rarest tokens only: each document meets the pivot (least key) of most of its regions
    few = stands.select("key", F.explode(F.slice("tokens", 1, FIRST)).alias("token"))
    heads, many = scratch.counted(few.groupBy("token").agg(F.min("key").alias("b"), F.count("*").alias("m")).where("m > 1").select("token", "b"), "heads")
    if many <= BROADCAST_ROWS:  # beyond it a token that very many documents share is split by adaptive execution
        heads = F.broadcast(heads)
    met = few.join(heads, "token").where("key <> b").groupBy("key", "b").agg(F.count("*").alias("m"))
    pairs = met.groupBy("key").agg(F.max_by("b", F.struct("m", -F.col("b"))).alias("b")).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()
    tested = _measured(pairs, stands)
    linked = tested.where(LINKED)
    keys = linked.select(F.col("a").alias("key")).unionAll(linked.select("b")).distinct()
    labels = _relabel(keys.withColumn("c", F.col("key")), linked)

    # then every token: the regions that still hold more than one component
    named = stands.select("key", "tokens").join(labels, "key", "left").select(F.explode("tokens").alias("token"), F.coalesce("c", "key").alias("c"))
    open_, many = scratch.counted(named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token"), "crowded")
    if many <= BROADCAST_ROWS:
        open_ = F.broadcast(open_)
    regions = scratch.materialize(windows.join(open_, "token", "left_semi"), "regions")
    keys = regions.select("key").distinct().join(labels, "key", "left_anti").withColumn("c", F.col("key"))
    labels = scratch.materialize(labels.unionByName(keys), "labels")

    before = math.inf
    for r in range(1, ROUNDS + 1):
        now = regions.join(labels, "key")
        crowds = now.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.min_by(F.struct("key", "n", "at", "c"), F.xxhash64("key", F.lit(r))).alias("p")).where("lo <> hi")
        crowds, many = scratch.counted(crowds.select("token", "p", "m"), "crowds")
        if not many:
            break
        now = scratch.materialize(now.join(F.broadcast(crowds) if many <= BROADCAST_ROWS else crowds, "token"), "open")
        last, before = r == ROUNDS or many > 0.9 * before, many
        if last:
            pairs = _left_over(now, tested, stands)
        else:
            near = now.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("c").alias("c_a"), F.col("p.key").alias("b"), F.col("p.n").alias("n_b"), F.col("p.at").alias("at_b"), F.col("p.c").alias("c_b"))
            pairs = near.where(f"c_a <> c_b and {POSSIBLE}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        done = _measured(pairs, stands)
        tested = tested.unionAll(done)
        labels = _relabel(labels, done.where(LINKED))
        if last:
            break
        regions = now.select("token", "key", "n", "at")
    return rows, labels


def _left_over(now: DataFrame, tested: DataFrame, stands: DataFrame) -> DataFrame:
    """Pairs of different components that share a region and that neither bounds, classes nor pivots rule out.

    A crowded region is cut into parts of about PART documents, each of which meets all of the region in a task of its own.
    A pair comes up in the region of its first common token only: while its components differ, all its regions are open.
    """
    open_ = now.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))  # of a document's window, in order
    rows = now.select("token", "key", "n", "at", "c", F.ceil(F.col("m") / PART).cast("int").alias("parts")).join(stands.select("key", "counts"), "key").join(open_, "key")
    own, every = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x, y = (rows.select(F.col("token").alias(f"token_{s}"), part.alias(f"part_{s}"), F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "at", "c", "counts", "tokens")]) for s, part in (("a", own), ("b", every)))
    pairs = x.join(y, F.expr(f"token_a = token_b and part_a = part_b and a < b and c_a <> c_b and {POSSIBLE} and {CLASSED} and array_intersect(tokens_a, tokens_b)[0] = token_a")).select("a", "b").distinct()
    d = (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("d")
    far = tested.select(F.col("a").alias("key"), "b", d).unionAll(tested.select(F.col("b").alias("key"), F.col("a").alias("b"), d))
    pivots = far.groupBy("b").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "b").limit(PIVOTS).select("b")
    far = far.join(F.broadcast(pivots), "b").groupBy("key").agg(F.collect_list(F.struct("b", "d")).alias("far"))
    near = pairs.join(far.toDF("a", "far_a"), "a", "left").join(far.toDF("b", "far_b"), "b", "left")
    apart = F.exists("far_a", lambda p: F.exists("far_b", lambda q: (p["b"] == q["b"]) & (F.abs(p["d"] - q["d"]) > 0.2 + 1e-9)))
    return near.where(~F.coalesce(apart, F.lit(False))).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, n_shingles, key: equal for equal sets, component_id: the least doc_id that links reach)."""
    rows, labels = _components(*B.pack(docs, id_col, text_col))
    ids = labels.join(rows.where("ids is not null").select("key", "print", "doc_id"), "key")
    least = ids.join(ids.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("print", "component_id")
    alone = rows.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("least"))
    groups = alone.join(least, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    # a set is looked up once for each block that has it, and its rows are found by block: copies of one text meet in no task
    answers = rows.where("n > 0").select("block", "print").distinct().join(groups, "print")
    out = rows.select("block", "doc_id", F.col("n").alias("n_shingles"), "print").join(answers, ["block", "print"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("key"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, and the columns of keep) of one document of each component, the one with the least id."""
    table, size = B.pack(docs, id_col, text_col, keep)
    rows, labels = _components(table, size)
    own = F.struct(F.coalesce("doc_id", F.lit(int(MAX_ID))).alias("i"), "block", "place")
    placed = rows.where("n > 0").groupBy("print").agg(F.min(own).alias("own"), F.max(F.when(F.col("ids").isNotNull(), F.col("key"))).alias("key"))
    joined = placed.where("key is not null").join(labels, "key", "left").groupBy(F.coalesce("c", "key").alias("c")).agg(F.min("own").alias("own"))
    firsts = joined.select("own.block", "own.place").unionAll(placed.where("key is null").select("own.block", "own.place"))
    stay = firsts.unionAll(rows.where("n = 0").select("block", "place")).groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("stay"))
    kinds = dict(docs.dtypes)
    schema = "doc_id long, text string" + "".join(f", x{i} {kinds[c]}" for i, c in enumerate(keep))
    names = ["doc_id", "text", *[f"x{i}" for i in range(len(keep))]]

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                b, at = B.row(one), one.column("stay").flatten()
                yield pa.RecordBatch.from_arrays([x.take(at) for x in (b["ids"], b["texts"], *b["kept"])], names)

    done = table.join(stay.hint("shuffle_hash"), "block").mapInArrow(run, schema)
    return done.select("doc_id", "text", *[F.col(f"x{i}").alias(c) for i, c in enumerate(keep)])


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")

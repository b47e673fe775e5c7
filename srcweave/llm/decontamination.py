"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window is ``WIDTH`` consecutive words of an item, or the whole of a shorter item. Its set is its shingles of
``SHINGLE`` words (or the one whole sequence where it is shorter). To be contained in a document all of the set must
be there, so the necessary prefix is one shingle: the rarest. Method:

1. Count, over every document, the benchmark's distinct shingles. A window with a shingle that no document has is
   dropped there and then.
2. Order each window's shingles by that rarity and index the rarest, with its offset in the window.
3. Look up the documents' shingles in the index. A match fixes where the window would have to start (positional
   bound); start and end must lie within the document (length bound); the window's words are then compared by two
   independent 64-bit hashes.

Items come in blocks of up to ``BLOCK_WORDS`` words, a longer item in overlapping parts with the same windows, so what
is broadcast has that bound whatever the benchmark's size; each further block is one more pass in the same job. Documents are not shuffled, and each document's result
depends on it alone, so no key or group can make a task uneven.

Cases: null or empty texts have no words and no hits; null or empty items have no windows; ids of items are counted
once, and so are all items without an id together, which hit like others and are a null in ``items``; repeated documents
get a result each; empty tables give no hits or an empty result. Only the id and text columns of either table are read,
and columns in ``keep`` are handed on whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import ALNUM, Words, chunks, grams, words

WIDTH = 10
SHINGLE = 5
BLOCK_WORDS = 2_000_000
U = np.uint64
_BITS = 1 << 20


class _Table:
    """Sorted distinct hashes with a bit filter in front."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.filter = np.zeros(_BITS, bool)
        self.filter[(self.values & U(_BITS - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in values) of the hashes that are there."""
        at = np.flatnonzero(self.filter[(h & U(_BITS - 1)).astype(np.int64)] & valid)
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        same = self.values[k] == h[at]
        return at[same], k[same]


def _windows(texts: pa.Array) -> dict[str, np.ndarray]:
    """The distinct windows of each item: item, start word, length, two hashes."""
    w = words(texts, ALNUM, True)
    doc, left, n = w.doc(), w.left(), w.counts
    length = np.minimum(WIDTH, n)[doc] if len(w) else np.empty(0, np.int64)
    at = np.flatnonzero(left >= length)
    h, other = w.hashes(), w.hashes(1)
    out = {"item": doc[at], "start": at, "length": length[at], "h1": np.zeros(len(at), U), "h2": np.zeros(len(at), U)}
    for size in np.unique(out["length"]):
        k = out["length"] == size
        out["h1"][k], out["h2"][k] = grams(h, int(size))[at[k]], grams(other, int(size), 1)[at[k]]
    order = np.lexsort((out["h2"], out["h1"], out["item"]))
    out = {k: v[order] for k, v in out.items()}
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = np.any([out[k][1:] != out[k][:-1] for k in ("item", "h1", "h2", "length")], axis=0)
        out = {k: v[new] for k, v in out.items()}
    return out | {"words": h}


def _shingles(win: dict[str, np.ndarray]) -> dict[int, np.ndarray]:
    """Shingle hashes at every word of the items, by shingle size."""
    return {int(k): grams(win["words"], int(k)) for k in np.unique(np.minimum(win["length"], SHINGLE))}


def _corpus_counts(docs: DataFrame, tables: dict[int, _Table]) -> dict[int, np.ndarray]:
    """How often all documents have each shingle; what comes back is bounded by the block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def count(it):
        sums = {k: np.zeros(len(t.values), np.int64) for k, t in shared.value.items()}
        for b in it:
            for lo, hi in chunks(b.column(0)):
                w = words(b.column(0).slice(lo, hi - lo), ALNUM, True)
                h, left = w.hashes(), w.left()
                for k, t in shared.value.items():
                    np.add.at(sums[k], t.find(grams(h, k), left >= k)[1], 1)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], ["size", "at", "n"])

    out = {k: np.zeros(len(t.values), np.int64) for k, t in tables.items()}
    for r in docs.mapInArrow(count, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
        out[r["size"]][r["at"]] = r["n"]
    return out


def _index(docs: DataFrame, texts: pa.Array) -> dict[int, tuple[_Table, np.ndarray, dict[str, np.ndarray]]]:
    """By shingle size: the rarest shingles, where each one's windows begin, and the windows with the offset in them."""
    win = _windows(texts)
    shingles = _shingles(win)
    small = np.minimum(win["length"], SHINGLE)
    tables = {}
    for k, g in shingles.items():
        own = small == k
        places = [win["start"][own & (win["length"] - k >= o)] + o for o in range(WIDTH - k + 1)]
        tables[k] = _Table(g[np.concatenate(places)])
    counts = _corpus_counts(docs, tables) if tables else {}
    out = {}
    for k, g in shingles.items():
        own = np.flatnonzero(small == k)
        best = np.full(len(own), np.iinfo(np.int64).max)
        offset = np.zeros(len(own), np.int64)
        for o in range(WIDTH - k + 1):
            has = win["length"][own] - k >= o
            n = counts[k][np.searchsorted(tables[k].values, g[np.minimum(win["start"][own] + o, len(g) - 1)]).clip(max=len(tables[k].values) - 1)]
            rarer = has & (n < best)
            best[rarer], offset[rarer] = n[rarer], o
        own, offset = own[best > 0], offset[best > 0]
        if len(own):
            rare = g[win["start"][own] + offset]
            order = np.argsort(rare, kind="stable")
            own, offset, rare = own[order], offset[order], rare[order]
            table = _Table(rare)
            first = np.searchsorted(rare, np.append(table.values, U(0xFFFFFFFFFFFFFFFF)), "left")
            first[-1] = len(rare)
            out[k] = (table, first, {n: win[n][own] for n in ("item", "length", "h1", "h2")} | {"offset": offset})
    return out


def _hits(w: Words, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item) of all windows that occur."""
    found = []
    h, left, first = w.hashes(), w.left(), w.first[w.doc()] if len(w) else np.empty(0, np.int64)
    by_length: dict[int, tuple] = {}
    other = None
    for k, (table, begin, win) in index.items():
        at, v = table.find(grams(h, k), left >= k)
        n = begin[v + 1] - begin[v]
        each = np.repeat(begin[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = np.repeat(at, n) - win["offset"][each]
        ok = (start >= np.repeat(first[at], n)) & (left[np.maximum(start, 0)] >= win["length"][each])
        start, each = start[ok], each[ok]
        for size in np.unique(win["length"][each]):
            if size not in by_length:
                other = w.hashes(1) if other is None else other
                by_length[size] = grams(h, int(size)), grams(other, int(size), 1)
            g1, g2 = by_length[size]
            s, e = start[win["length"][each] == size], each[win["length"][each] == size]
            same = (g1[s] == win["h1"][e]) & (g2[s] == win["h2"][e])
            found.append((s[same], np.full(int(same.sum()), size), win["item"][e[same]]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))


def _search(it, shared):
    index, names = shared.value
    for b in it:
        for lo, hi in chunks(b.column("text")):
            part = b.slice(lo, hi - lo)
            w = words(part.column("text"), ALNUM, True)
            start, length, item = _hits(w, index)
            step = np.zeros(len(w) + 1, np.int64)
            np.add.at(step, start, 1)
            np.subtract.at(step, start + length, 1)
            hit = np.flatnonzero(np.cumsum(step)[:-1] > 0)
            hits, items = part.column("hits").to_pylist(), part.column("items").to_pylist()
            doc = w.doc()
            for d in np.unique(doc[hit]).tolist():
                hits[d] = sorted({*hits[d], *(hit[doc[hit] == d] - w.first[d]).tolist()})
                items[d] = sorted({*items[d], *(names[i] for i in np.unique(item[doc[start] == d]).tolist())}, key=lambda x: (x is None, x))
            found = [part.column("doc_id"), part.column("text"), pa.array(w.counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*found, *part.columns[5:]], part.schema.names)


def _parts(text: str) -> Iterator[str]:
    """A text of up to BLOCK_WORDS words itself; a longer one in parts that share WIDTH - 1 words."""
    if len(text) < 2 * BLOCK_WORDS:
        yield text
        return
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    for lo in range(0, max(len(found) - WIDTH + 1, 1), BLOCK_WORDS):
        yield " ".join(found[lo : lo + BLOCK_WORDS + WIDTH - 1])


def _blocks(items: DataFrame) -> Iterator[tuple[list[str], pa.Array]]:
    """Items a block at a time."""
    names, texts, size = [], [], 0
    for r in items.toLocalIterator():
        for text in _parts(r[1]):
            names.append(r[0])
            texts.append(text)
            size += len(text) // 2 + 1
            if size >= BLOCK_WORDS:
                yield names, pa.array(texts, pa.string())
                names, texts, size = [], [], 0
    yield names, pa.array(texts, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document (doc_id, text, n_words, hits: numbers of the words inside an item's window, items: ids found, and the columns of keep)."""
    spark = docs.sparkSession
    more = [F.col(c).alias(f"x{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    out = rows.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), *[F.col(f"x{i}") for i in range(len(keep))])
    schema = ", ".join(f"{c} {t}" for c, t in out.dtypes)
    items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull())
    for names, texts in _blocks(items):
        shared = spark.sparkContext.broadcast((_index(rows.select("text"), texts), names))
        out = out.mapInArrow(lambda it, shared=shared: _search(it, shared), schema)
    return out.withColumnsRenamed({f"x{i}": c for i, c in enumerate(keep)})


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    done = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return done.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )

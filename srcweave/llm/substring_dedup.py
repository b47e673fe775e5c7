"""Substring dedup: words inside any window of ``width`` words that also starts anywhere else are removed.

Method: a Count-min prefilter, then an exact pass.

1. Documents are packed into blocks (``blocks``). Each block makes a Count-min sketch of its windows: ``ROWS`` rows
   of counters, four for each window of the corpus, so the sketch grows with the corpus and its false-positive rate
   doesn't. A block's sketch is sparse; it goes out as sorted counter numbers, cut by slices of the counters.
2. The task of a slice adds up all blocks' counters (the merged sketch) and tells each block which of its counters
   reached two. A counter never underestimates, so a window that repeats has two or more in each row.
3. Windows with two or more in every row are candidates. Each block sends their exact keys (96 hash bits), once
   each with a mark for "several times in this block"; slices group them exactly and reply which really repeat.
4. Each block covers the repeated windows' words and joins the words left.

Texts are never shuffled and no window's occurrences are ever gathered: a window found in a third of all documents
is one value per block.

Cases: a null or empty text has no words and an empty kept text; texts of fewer than ``width`` words are kept whole;
repeated rows, also with equal ids, count as separate documents, each with a result row; an empty table gives an
empty result. Only the id and text columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans import scratch
from . import blocks as B
from .textkit import SPACED, grams, mix, words

WIDTH = 35
ROWS = 2
CELLS = 1 << 22  # counters in a slice of one row
U = np.uint64
RESULT = "doc_id long, text string, n_words long, n_removed long"


def _cells(h: np.ndarray, r: int, slices: int) -> np.ndarray:
    """Counter numbers in row r: slice * CELLS + counter, slices numbered on through the rows."""
    x = mix(h, r + 1)
    return ((x >> U(32)) % U(slices) + U(r * slices)) * U(CELLS) + (x & U(CELLS - 1))


def _windows(block: dict, width: int):
    w = words(block["texts"], SPACED)
    return w, grams(w.hashes(), width), w.left() >= width


def _sketch(block: dict, width: int, slices: int):
    _, h, valid = _windows(block, width)
    for r in range(ROWS):
        cells, twice = B.unique(_cells(h[valid], r, slices))
        for s, a, b in B.cuts((cells // U(CELLS)).astype(np.int64)):
            yield s, B.framed(B.encode((cells[a:b] % U(CELLS)).astype(np.uint32)), B.bits(twice[a:b]))


def _merge_sketches(sent: list[bytes]) -> list[bytes]:
    counters = np.zeros(CELLS, np.uint8)
    got = []
    for data in sent:
        cells, twice = B.parts(data)
        cells = B.decode(cells, np.uint32)
        got.append(cells)
        counters[cells] = np.minimum(counters[cells] + 1 + B.flags(twice, len(cells)), 2)
    return [B.bits(counters[c] >= 2) for c in got]


def _candidates(block: dict, width: int, slices: int):
    """Candidate windows' places, and their keys in order: (words, places, order, h1, h2) with keys sorted by slice."""
    w, h, valid = _windows(block, width)
    at = np.flatnonzero(valid)
    keep = np.ones(len(at), bool)
    for r in range(ROWS):
        cells = _cells(h[at], r, slices)
        order = np.argsort(cells)
        new = np.diff(cells[order], prepend=U(0xFFFFFFFFFFFFFFFF)) != 0
        distinct = cells[order][new]
        hit = np.zeros(len(distinct), bool)
        for s, a, b in B.cuts((distinct // U(CELLS)).astype(np.int64)):
            hit[a:b] = B.flags(block["replies"][(0, s)], b - a)
        keep[order] &= hit[np.cumsum(new) - 1]
    at = at[keep]
    h1, h2 = h[at], mix(grams(w.hashes(1), width, 1)[at], 9) >> U(32)
    order = np.lexsort((h2, h1))
    return w, at, order, h1[order], h2[order].astype(np.uint32)


def _slice_of(h1: np.ndarray, slices: int) -> np.ndarray:
    return (((h1 >> U(33)) * U(slices)) >> U(31)).astype(np.int64)


def _distinct(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return new


def _keys(block: dict, width: int, slices: int):
    _, _, _, h1, h2 = _candidates(block, width, slices)
    new = np.flatnonzero(_distinct(h1, h2))
    twice = np.diff(np.append(new, len(h1))) > 1
    k1, k2 = h1[new], h2[new]
    for s, a, b in B.cuts(_slice_of(k1, slices)):
        yield s, B.framed(B.encode(k1[a:b]), k2[a:b].tobytes(), B.bits(twice[a:b]))


def _group_keys(sent: list[bytes]) -> list[bytes]:
    k1, k2, n = [], [], []
    for data in sent:
        a, b, c = B.parts(data)
        k1.append(B.decode(a, U))
        k2.append(np.frombuffer(b, np.uint32))
        n.append(1 + B.flags(c, len(k2[-1])).astype(np.int64))
    h1, h2 = np.concatenate(k1), np.concatenate(k2)
    order = np.lexsort((h2, h1))
    new = _distinct(h1[order], h2[order])
    total = np.add.reduceat(np.concatenate(n)[order], np.flatnonzero(new))
    repeated = np.empty(len(order), bool)
    repeated[order] = (total >= 2)[np.cumsum(new) - 1]
    return [B.bits(x) for x in np.split(repeated, np.cumsum([len(k) for k in k1])[:-1])]


def _apply(block: dict, width: int, slices: int) -> pa.RecordBatch:
    w, at, order, h1, h2 = _candidates(block, width, slices)
    new = _distinct(h1, h2)
    k1 = h1[new]
    hit = np.zeros(len(k1), bool)
    for s, a, b in B.cuts(_slice_of(k1, slices)):
        hit[a:b] = B.flags(block["replies"][(1, s)], b - a)
    starts = np.zeros(len(w) + 1, np.int64)
    starts[at[order[hit[np.cumsum(new) - 1]]] + 1] = 1
    seen = np.cumsum(starts)
    n = np.arange(len(w))
    covered = seen[n + 1] > seen[np.maximum(n - width + 1, 0)]
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])
    return pa.RecordBatch.from_arrays(
        [block["ids"], w.text_of(~covered), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"]
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document (doc_id, text: the words kept joined by one blank, n_words, n_removed)."""
    table, size = B.pack(docs, id_col, text_col)
    slices = max(1, math.ceil(size / 6 / B.SLICE_VALUES))  # about six bytes a word; another length only changes the load
    first = scratch.materialize(B.merge(B.ask(table, lambda b: _sketch(b, width, slices)), 0, _merge_sketches), "sketch")
    second = B.merge(B.ask(B.with_replies(table, first), lambda b: _keys(b, width, slices)), 1, _group_keys)

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                yield _apply(B.row(batch.slice(k, 1)), width, slices)

    return B.with_replies(table, first, second).mapInArrow(run, RESULT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

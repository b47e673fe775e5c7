"""Line dedup: later copies of runs of ``MIN_LINES`` or more lines are deleted, and of single lines of ``MIN_WORDS`` words.

A document is a sequence of line ids (128-bit hashes of its lines; empty lines take no part). Method: the suffixes of all
sequences are put into classes by prefix doubling. Round j names the class of each suffix's first 2^j lines from the
names at the suffix and 2^(j-1) lines further on; a suffix whose class has one member has its final place in the suffix
array and drops out, and rounds go on until every class has one member. Names are hashes rather than dense ranks: the
members of a class are neighbours in the order of names all the same, which is all that is asked of the array, and no
global sort is made. A class of several members at 2^j lines is an interval of the array whose longest common prefix
is that long or longer. Its first member, by document id, text checksum and place, is the original and the others are
later copies; each suffix keeps the original of the deepest interval in which it is a later copy. Neighbouring suffixes
whose originals are neighbours too are told as one copied run, as long as its last interval reaches (``copies``). Depths are
powers of two and no longest common prefix is computed in between, so where an earlier document has a part of a run of
another length, that run is told as two overlapping copies with an original each. What copies cover together is all that
is deleted (``runs``), and that doesn't depend on how they are told.

Names are exchanged by ``blocks``: each block sends a name once with its own first place, however often it has it, so
a line that a third of all documents share makes no task large, and texts are not shuffled. From the second round on
only the lines that repeat take part, held in a table of arrays for each block; the number of rounds is the logarithm
of the longest repeated run, and each leaves its table in the shared folder.

Cases: a null text stays null and an empty one empty, without lines; documents without later copies keep their text
unchanged; documents of which all lines go have an empty text; of repeated rows one stays, the one whose block comes
first where ids and texts are equal; an empty table gives an empty result. Columns in ``keep`` are handed on whatever
their names; others are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .textkit import LINES, SPACED, grams, mix, words

MIN_LINES = 2
MIN_WORDS = 50
U = np.uint64
NO_ID = np.iinfo(np.int64).min


@dataclass
class _State:
    """A block's lines that take part, in order of document and place. The last five are of the deepest later copy."""

    ids: np.ndarray  # for each document of the block: id, checksum, rank among the block's documents
    sums: np.ndarray
    rank: np.ndarray
    doc: np.ndarray  # for each line: document, place among its lines, hashes, whether its class repeats
    place: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    again: np.ndarray
    size: np.ndarray  # lines of the interval, 0: no later copy; the original's block, document, place, id
    o_block: np.ndarray
    o_doc: np.ndarray
    o_place: np.ndarray
    o_id: np.ndarray

    def dump(self) -> bytes:
        return zstandard.compress(B.framed(*[getattr(self, f.name).tobytes() for f in fields(self)]), 1)

    @classmethod
    def load(cls, data: bytes) -> _State:
        got = B.parts(zstandard.decompress(data))
        return cls(*[np.frombuffer(x, k).copy() for x, k in zip(got, _KINDS, strict=True)])


_KINDS = (np.int64, U, np.int64, np.int64, np.int64, U, U, bool, np.int64, np.int64, np.int64, np.int64, np.int64)


def _lines(block: dict) -> _State:
    """All lines of a block of texts."""
    w = words(block["texts"], LINES, blank=10)
    h, doc = w.hashes(), w.doc()
    place = np.arange(len(h)) - w.first[doc]
    ids = block["ids"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
    sums = np.zeros(len(ids), U)
    np.add.at(sums, doc, mix(h + place.astype(U)))
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((sums, ids))] = np.arange(len(ids))
    none = [np.zeros(len(h), np.int64) for _ in range(5)]
    return _State(ids, sums, rank, doc, place, h, w.hashes(1), np.ones(len(h), bool), *none)


def _names(s: _State, size: int, last: int):
    """(suffixes whose first ``size`` lines may repeat, in the order of names and then of documents; names; where they begin)."""
    step, n = size - last if last else 0, len(s.doc)
    at = np.flatnonzero(s.again[: max(n - size + 1, 0)])
    end = at + size - 1
    at = at[(s.doc[end] == s.doc[at]) & (s.place[end] == s.place[at] + size - 1) & s.again[at + step]]
    n1, n2 = grams(s.h1, size)[at], grams(s.h2, size, 1)[at]
    order = np.lexsort((at, s.rank[s.doc[at]], n2, n1))
    at, n1, n2 = at[order], n1[order], n2[order]
    new = np.ones(len(at), bool)
    new[1:] = (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])
    return at, n1, n2, new


def _slice(n1: np.ndarray, slices: int) -> np.ndarray:
    return (((n1 >> U(33)) * U(slices)) >> U(31)).astype(np.int64)


def _send(s: _State, block: int, size: int, last: int, slices: int):
    at, n1, n2, new = _names(s, size, last)
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(at))) > 1
    doc, place = s.doc[at[first]], s.place[at[first]]
    for k, a, b in B.cuts(_slice(n1[first], slices)):
        d = doc[a:b]
        rest = [x.tobytes() for x in (s.ids[d], s.sums[d], d, place[a:b])]
        yield k, B.framed(block.to_bytes(8, "little", signed=True), B.encode(n1[first[a:b]]), n2[first[a:b]].tobytes(), B.bits(twice[a:b]), zstandard.compress(B.framed(*rest), 1))


def _merge(sent: list[bytes]) -> list[bytes]:
    """For each name sent: does it repeat, and is its first place of all this block's; else whose it is."""
    got = [B.parts(x) for x in sent]
    n1 = [B.decode(x[1], U) for x in got]
    sizes = [len(x) for x in n1]
    block = np.repeat([int.from_bytes(x[0], "little", signed=True) for x in got], sizes)
    n1, n2 = np.concatenate(n1), np.concatenate([np.frombuffer(x[2], U) for x in got])
    n = 1 + np.concatenate([B.flags(x[3], k) for x, k in zip(got, sizes, strict=True)]).astype(np.int64)
    rest = [B.parts(zstandard.decompress(x[4])) for x in got]
    ids, sums, doc, place = (np.concatenate([np.frombuffer(x[k], t) for x in rest]) for k, t in enumerate((np.int64, U, np.int64, np.int64)))
    order = np.lexsort((block, sums, ids, n2, n1))
    new = np.ones(len(order), bool)
    new[1:] = (n1[order][1:] != n1[order][:-1]) | (n2[order][1:] != n2[order][:-1])
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    again, own, owner = np.empty(len(order), bool), np.empty(len(order), bool), np.empty(len(order), np.int64)
    again[order] = (np.add.reduceat(n[order], starts) > 1)[group]
    own[order], owner[order] = new, order[starts][group]
    out, lo = [], 0
    for k in sizes:
        theirs = owner[lo : lo + k][~own[lo : lo + k]]
        of = [x[theirs].tobytes() for x in (block, doc, place, ids)]
        out.append(B.framed(B.bits(again[lo : lo + k]), B.bits(own[lo : lo + k]), zstandard.compress(B.framed(*of), 1)))
        lo += k
    return out


def _settle(s: _State, block: int, replies: dict, size: int, last: int, slices: int) -> _State:
    """The block's state after a round: which classes repeat, and originals of later copies."""
    at, n1, _, new = _names(s, size, last)
    first = np.flatnonzero(new)
    again, own = np.zeros(len(first), bool), np.zeros(len(first), bool)
    of = [np.full(len(first), block), s.doc[at[first]], s.place[at[first]], s.ids[s.doc[at[first]]]]
    for k, a, b in B.cuts(_slice(n1[first], slices)):
        x, y, theirs = B.parts(replies[(0, k)])
        again[a:b], own[a:b] = B.flags(x, b - a), B.flags(y, b - a)
        for mine, data in zip(of, B.parts(zstandard.decompress(theirs)), strict=True):
            mine[a:b][~own[a:b]] = np.frombuffer(data, np.int64)
    name = np.cumsum(new) - 1
    s.again[:] = False
    s.again[at] = again[name]
    later = again[name] & ~(new & own[name])
    p, name = at[later], name[later]
    s.size[p], s.o_block[p], s.o_doc[p], s.o_place[p], s.o_id[p] = size, *[x[name] for x in of]
    return s


def _only(s: _State, keep: np.ndarray) -> _State:
    return _State(s.ids, s.sums, s.rank, *[getattr(s, f.name)[keep] for f in fields(s)[3:]])


def _copies(s: _State, least: int, long: np.ndarray) -> list[tuple[int, int, int, int | None, int]]:
    """Copied runs (document, first line, lines, the original's id and line), by document and line."""
    at = np.flatnonzero((s.size >= least) | ((s.size > 0) & long))
    doc, place, end = s.doc[at], s.place[at], s.place[at] + s.size[at]
    go_on = np.zeros(len(at), bool)
    go_on[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1)
    for x, step in ((s.o_block[at], 0), (s.o_doc[at], 0), (s.o_place[at], 1)):
        go_on[1:] &= x[1:] == x[:-1] + step
    cuts = [*np.flatnonzero(~go_on).tolist(), len(at)]
    out, seen = [], (-1, -1)
    for k, z in zip(cuts[:-1], cuts[1:], strict=True):
        last = int(end[k:z].max())
        if seen[0] != doc[k] or last > seen[1]:  # else it lies inside a run before it
            original = int(s.o_id[at[k]])
            out.append((int(doc[k]), int(place[k]), last - int(place[k]), None if original == NO_ID else original, int(s.o_place[at[k]])))
            seen = (int(doc[k]), last)
    return out


def _apply(block: dict, s: _State, least: int, min_words: int, names: list[str]) -> pa.RecordBatch:
    texts = block["texts"]
    w = words(texts, LINES, blank=10)
    line = w.first[s.doc] + s.place
    long = np.zeros(len(s.doc), bool)
    if s.size.any():
        starts = words(texts, SPACED, blank=10).starts
        long = np.searchsorted(starts, w.ends[line]) - np.searchsorted(starts, w.starts[line]) >= min_words
    copies: list = [[] for _ in range(len(texts))]
    step = np.zeros(len(w) + 1, np.int64)
    for d, a, n, i, k in _copies(s, least, long):
        copies[d].append({"first": a, "lines": n, "of_id": i, "of_line": k})
        step[w.first[d] + a] += 1
        step[w.first[d] + a + n] -= 1
    gone = np.cumsum(step)[:-1] > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
    changed = np.flatnonzero(removed)
    out, runs = texts.to_pylist() if len(changed) else texts, [[]] * len(texts)
    for d in changed.tolist():
        drop = gone[w.first[d] : w.first[d + 1]]
        kept, k = [], 0
        for x in out[d].split("\n"):
            if not x:
                kept.append(x)
                continue
            if not drop[k]:
                kept.append(x)
            k += 1
        edge = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0, append=0))
        runs[d] = [{"first": a, "lines": z - a} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        out[d] = "\n".join(kept) if any(kept) else ""
    columns = [block["ids"], pa.array(out, pa.string()) if len(changed) else texts, pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, _RUNS), pa.array(copies, _COPIES)]
    return pa.RecordBatch.from_arrays([*columns, *block["kept"]], names)


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32())]))
_COPIES = pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32()), ("of_id", pa.int64()), ("of_line", pa.int32())]))
_SCHEMA = "doc_id long, text string, n_lines long, n_removed long, runs array<struct<first:int,lines:int>>, copies array<struct<first:int,lines:int,of_id:long,of_line:int>>"


def _each(batches, fn):
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            yield fn(one, one.column("block")[0].as_py())


def _stated(one: pa.RecordBatch) -> _State:
    return _State.load(one.column("state")[0].as_py())


def _replies(one: pa.RecordBatch) -> dict:
    return {(r["kind"], r["slice"]): r["data"] for r in (one.column("replies")[0].as_py() or [])}


def _state_row(block: int, s: _State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([int(s.again.sum())], pa.int64()), pa.array([s.dump()], pa.binary())], ["block", "open", "state"])


def _asked(rows: DataFrame, state, size: int, last: int, slices: int) -> DataFrame:
    """What each block sends in a round; ``state`` makes its state of a row."""

    def run(it):
        for sent, block in _each(it, lambda one, block: (list(_send(state(one), block, size, last, slices)), block)):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sent], pa.int32()), pa.array([block] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())], ["slice", "block", "data"])

    return rows.mapInArrow(run, "slice int, block long, data binary")


def _round(rows: DataFrame, state, size: int, last: int, slices: int, bytes_: int) -> DataFrame:
    """The blocks' states after the round of names of ``size`` lines."""
    replies = B.merge(_asked(rows, state, size, last, slices), 0, _merge)

    def run(it):
        def settled(one, block):
            s = _settle(state(one), block, _replies(one), size, last, slices)
            return _state_row(block, _only(s, s.again) if last == 0 else s)

        yield from _each(it, settled)

    return B.store(B.with_replies(rows, replies).mapInArrow(run, "block long, open long, state binary"), bytes_)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, keep: tuple[str, ...] = (), min_words: int = MIN_WORDS) -> DataFrame:
    """Per document (doc_id, text, n_lines, n_removed, runs: the stretches deleted, copies: copied runs with their originals, and the columns of keep)."""
    table, bytes_ = B.pack(docs, id_col, text_col, keep)
    slices = max(1, math.ceil(bytes_ / 50 / B.SLICE_VALUES))
    states = _round(table, lambda one: _lines(B.row(one)), 1, 0, slices, bytes_)
    size = 1
    while states.agg(F.sum("open")).first()[0]:  # some class has several members: twice as long, by way of the threshold
        last, size = size, min(2 * size, min_lines) if size < min_lines else 2 * size
        states = _round(states.select("block", "state"), _stated, size, last, slices, bytes_)
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + [f"x{i}" for i in range(len(keep))]
    kinds = dict(docs.dtypes)
    schema = _SCHEMA + "".join(f", x{i} {kinds[c]}" for i, c in enumerate(keep))

    def run(it):
        yield from _each(it, lambda one, _: _apply(B.row(one), _stated(one), min_lines, min_words, names))

    done = table.join(states.select("block", "state").hint("shuffle_hash"), "block").mapInArrow(run, schema)
    return done.select("doc_id", "text", "n_lines", "n_removed", "runs", "copies", *[F.col(f"x{i}").alias(c) for i, c in enumerate(keep)])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

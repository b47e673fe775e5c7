"""Packing: deficit round-robin over source queues fills every window to the target token proportions.

Each source is a queue of tokens, its documents end to end. Every round gives each queue credit in proportion to its
target share; whole tokens are taken, what is left of the credit is the queue's deficit and is carried to the next
window. Carried from the first window on, deficits sum up to a closed form: after w of W windows a queue with T tokens
has given floor(w * T / W), and the largest queue gives the rest up to floor(w * all / W). So each window's share of
each queue, with the deficits it inherits, is computed where it is needed: partitions need no messages, and a window
may take from documents of any partitions. Windows differ by at most one token and all padding together is less than
one window for each phase. With a mixture other than the corpus's own, a queue may run dry before the others; then a
new phase begins in which the remaining queues share by their targets, so every token is packed.

Every source has a queue of its own. The ``QUEUES`` - 1 sources with most bytes, and all that the mixture names, share
windows directly; the queues of the others are leaves of a binary tree whose root takes part as one more queue. What a
node has given is split between its children by the same closed form, so a leaf's tokens and their place in the window
come from one walk from root to leaf, and windows hold these sources' proportions to a token for each level. The
driver and the tasks hold a number and a sum for each source. Tokens are made once and written; the places of documents
in their queues come from one sum for each task and queue. A hot source is spread over all tasks like any other.

Words are encoded once for each worker process and compared with the encoded ones whole: the tokenizer never joins anything across ASCII white space, nor across
an ASCII letter and an ASCII digit or sign, so a text's ids are its words' ids end to end. Only the tokenizer's added
tokens reach across such cuts; a text that holds one, in any case of letters, is encoded whole.

Cases: a null or empty text is its end token alone; a null source is a source; repeated rows are packed each; an empty
table gives an empty result. Only the id, text and source columns are read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import scratch
from .textkit import LOWER, SPACED, Words, chunks, words

LENGTH = 2048
END = 1
QUEUES = 32
KNOWN_WORDS = 1_000_000
ENCODED_AT_ONCE = 4096
TEMPERATURE = 0.7
BROADCAST_ROWS = 500_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER = np.zeros(256, bool)
_OTHER[0x21:0x7F] = True
_OTHER[_ALPHA] = False
_OTHER[0x27] = False


def _units(texts: pa.Array) -> Words:
    """What is encoded by itself: words, cut further between an ASCII letter and an ASCII digit or sign.

    The tokenizer lower-cases, and no token of it spans white space or such a cut; apostrophes begin contractions and
    so never make one. Capitals before anything beyond ASCII stay: the tokenizer composes marks before it lower-cases.
    """
    w = words(texts, SPACED)
    buf = np.where(np.append(w.buf[1:], np.uint8(32)) < 128, LOWER[w.buf], w.buf)
    alpha, other = _ALPHA[buf], _OTHER[buf]
    cut = np.flatnonzero((alpha[:-1] & other[1:]) | (other[:-1] & alpha[1:])) + 1
    starts, ends = np.sort(np.concatenate([w.starts, cut])), np.sort(np.concatenate([w.ends, cut]))
    begin = np.append(w.starts, len(w.buf))[w.first]
    return Words(buf, starts, ends, np.searchsorted(starts, begin))


class Encoder:
    """Ids of texts by way of the ids of their words; holds up to KNOWN_WORDS words, sorted by hash.

    A word's hash only finds its place: the word itself is compared, lane by lane, with the one that is known there, and
    a text with any that differs is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(added)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at, self.size, self.bytes, self.lane_at = (np.empty(0, np.int64) for _ in range(4))
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.lanes, self.lanes_used = np.empty(1 << 14, np.uint64), 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ids, sizes = [], []
        for lo in range(0, len(texts), ENCODED_AT_ONCE):
            lists = [e.ids for e in self.batch(texts[lo : lo + ENCODED_AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter((x for v in lists for x in v), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, w: Words) -> None:
        raw = w.buf.tobytes()
        ids, size = self._ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)])
        lanes, n = w.lanes()
        self.flat, self.lanes = _room(self.flat, self.used + len(ids)), _room(self.lanes, self.lanes_used + len(lanes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lanes[self.lanes_used : self.lanes_used + len(lanes)] = lanes
        place = np.searchsorted(self.known, hashes)
        new = {"known": hashes, "at": self.used + np.cumsum(size) - size, "size": size, "bytes": w.ends - w.starts, "lane_at": self.lanes_used + np.cumsum(n) - n}
        for k, v in new.items():
            setattr(self, k, np.insert(getattr(self, k), place, v))
        self.used += len(ids)
        self.lanes_used += len(lanes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by END; number of ids of each)."""
        whole = np.zeros(len(texts), bool)
        if self.added:
            whole = pc.match_substring_regex(texts, self.added, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        out, n, strange = self._by_units(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        if len(strange):
            whole = whole | np.isin(np.arange(len(texts)), strange)
            out, n, _ = self._by_units(pc.if_else(pa.array(whole), "", texts))
        at = np.flatnonzero(whole)
        if len(at):
            ids, size = self._ids(texts.take(pa.array(at)).to_pylist())
            out = np.insert(out, np.repeat((np.cumsum(n) - n)[at], size), ids)
            n[at] += size
        return out, n

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each, texts with a word that isn't the known one of its hash)."""
        w = _units(texts)
        distinct, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KNOWN_WORDS:
            self.clear()
        slot = np.searchsorted(self.known, distinct)
        new = np.flatnonzero((slot == len(self.known)) | (np.append(self.known, np.uint64(0))[slot] != distinct))
        if len(new):
            self._learn(distinct[new], Words(w.buf, w.starts[first[new]], w.ends[first[new]], np.array([0, len(new)])))
            slot = np.searchsorted(self.known, distinct)
        slot = slot[which]
        strange = np.unique(w.doc()[self._differ(w, slot)])
        # the end token takes part as one more word after each text's words
        place = np.arange(len(w)) + w.doc()
        n = np.ones(len(w) + len(texts), np.int64)
        n[place] = self.size[slot]
        out = np.full(int(n.sum()), END, np.uint32)
        begin = np.cumsum(n) - n
        each = n[place]
        src = np.repeat(self.at[slot] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        dst = np.repeat(begin[place] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        out[dst] = self.flat[src]
        ends = np.cumsum(n)[w.first[1:] + np.arange(len(texts))]
        return out, np.diff(ends, prepend=0), strange

    def _differ(self, w: Words, slot: np.ndarray) -> np.ndarray:
        """Which words are not the known ones at these places."""
        other = self.bytes[slot] != w.ends - w.starts
        lanes, n = w.lanes()
        at = np.repeat(np.where(other, 0, self.lane_at[slot]) - (np.cumsum(n) - n), n) + np.arange(len(lanes))
        wrong = lanes != self.lanes[np.minimum(at, len(self.lanes) - 1)]
        if wrong.any():
            other[np.repeat(np.arange(len(w)), n)[wrong]] = True
        return other


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.resize(a, 2 * n)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, which goes on to other tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokens(it, path: str, queues: dict):
    from pyspark import TaskContext

    part, encoder, given = TaskContext.get().partitionId(), _encoder(path), np.zeros(len(queues), np.int64)
    for b in it:
        for lo, hi in chunks(b.column("text")):
            rows = b.slice(lo, hi - lo)
            ids, n = encoder.encode(rows.column("text"))
            queue = np.array([queues[s] for s in rows.column("source").to_pylist()], np.int64)
            order = np.argsort(queue, kind="stable")
            q, first, which = np.unique(queue[order], return_index=True, return_inverse=True)
            before = np.cumsum(n[order]) - n[order]
            start = np.empty(len(n), np.int64)
            start[order] = given[q][which] + before - before[first][which]
            np.add.at(given, queue, n)
            off = np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(queue, pa.int32()), pa.array(np.full(len(n), part), pa.int32()), pa.array(start), pa.array(n), data],
                ["doc_id", "queue", "part", "start", "n", "ids"],
            )


class Phase:
    """Windows base .. base+W-1 over tokens begin[q] .. begin[q]+total[q]-1 of each queue."""

    def __init__(self, base: int, begin: list[int], total: list[int], length: int):
        self.base, self.begin, self.total, self.all = base, begin, total, sum(total)
        self.windows = -(-self.all // length)
        self.rest = max(range(len(total)), key=lambda q: total[q]) if total else 0
        self.exact = self.windows >= 3_000_000_000  # beyond it products leave 64 bits: Python's integers

    def _share(self, w: np.ndarray, total: int) -> np.ndarray:
        a, b = divmod(total, self.windows)
        return w * a + w * b // self.windows

    def given(self, q: int, w: np.ndarray) -> np.ndarray:
        """Tokens that queue q has given before window w."""
        w = w.astype(object) if self.exact else w
        if q != self.rest:
            return self._share(w, self.total[q])
        return self._share(w, self.all) - sum(self._share(w, t) for k, t in enumerate(self.total) if k != q)

    def window(self, q: int, token: np.ndarray) -> np.ndarray:
        """The window that gets this token of queue q."""
        lo, hi = np.zeros(len(token), np.int64), np.full(len(token), self.windows - 1)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            right = self.given(q, mid + 1) <= token
            lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, mid)
        return lo


def phases(totals: list[int], target: list[float] | None, length: int = LENGTH) -> list[Phase]:
    """One phase, or with target shares one for each time a queue runs dry."""
    done, out, base = [0] * len(totals), [], 0
    while sum(totals) > sum(done):
        left = [t - d for t, d in zip(totals, done, strict=True)]
        take = left
        if target:
            share = [m if n else 0.0 for m, n in zip(target, left, strict=True)]
            if sum(share) > 0:
                time = min(n / m for n, m in zip(left, share, strict=True) if m > 0)
                take = [min(n, round(m * time)) for n, m in zip(left, share, strict=True)]
                dry = min((k for k in range(len(left)) if share[k] > 0), key=lambda k: left[k] / share[k])
                take[dry] = left[dry]
        out.append(Phase(base, list(done), take, length))
        base += out[-1].windows
        done = [d + t for d, t in zip(done, take, strict=True)]
    return out


class Tree:
    """Queues that share one: each node's tokens are split between its two children in proportion, in whole tokens."""

    def __init__(self, totals: list[int]):
        self.levels = [np.array(totals, np.int64)]
        while len(self.levels[0]) > 1:
            x = np.append(self.levels[0], np.zeros(len(self.levels[0]) % 2, np.int64))
            self.levels.insert(0, x[::2] + x[1::2])
        self.total = int(self.levels[0].sum())

    def _walk(self, leaf: np.ndarray, *given: np.ndarray):
        """For each count given by the root: (by the leaf, by all leaves before it)."""
        own, before = list(given), [np.zeros(len(leaf), np.int64) for _ in given]
        for d in range(1, len(self.levels)):
            node = leaf >> (len(self.levels) - 1 - d)
            up, left, right = np.maximum(self.levels[d - 1][node >> 1], 1), self.levels[d][node & ~1], (node & 1) == 1
            for k, n in enumerate(own):
                # floor(n * left / up): the product may leave 64 bits, the remainder doesn't
                got = np.floor(n * (left / up)).astype(np.int64)
                rest = n * left - got * up
                got += (rest >= up).astype(np.int64) - (rest < 0)
                before[k] = before[k] + np.where(right, got, 0)
                own[k] = np.where(right, n - got, got)
        return list(zip(own, before, strict=True))

    def given(self, leaf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tokens of the leaf among the first n of the root."""
        return self._walk(leaf, n)[0][0]

    def before(self, leaf: np.ndarray, n: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the leaves before it among the root's n .. end-1."""
        (_, a), (_, z) = self._walk(leaf, n, end)
        return z - a


class _Pooled:
    """A phase's windows for the leaves of the tree behind the last of its queues."""

    def __init__(self, p: Phase, q: int, tree: Tree):
        self.p, self.q, self.tree = p, q, tree

    def root(self, w: np.ndarray) -> np.ndarray:
        return self.p.begin[self.q] + self.p.given(self.q, w).astype(np.int64)

    def given(self, leaf: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.tree.given(leaf, self.root(w))

    def window(self, leaf: np.ndarray, token: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(token), np.int64), np.full(len(token), self.p.windows - 1)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            right = self.given(leaf, mid + 1) <= token
            lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, mid)
        return lo


def _pieces(it, plan: list[Phase], with_ids: bool, other: int, tree: Tree | None):
    for b in it:
        queue, start, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "start", "n"))
        ids, doc_id = b.column("ids"), b.column("doc_id")
        row, first, size, seq, offset = [], [], [], [], []
        here = np.unique(np.minimum(queue, other)).tolist()
        for p in plan:
            for q in here:
                if not p.total[q]:
                    continue
                mine = np.flatnonzero(np.minimum(queue, other) == q)
                leaf = queue[mine] - other
                pool = _Pooled(p, q, tree) if q == other else None
                begin, end = p.begin[q], p.begin[q] + p.total[q]
                if pool:
                    begin, end = (tree.given(leaf, np.full(len(leaf), x)) for x in (begin, end))
                lo, hi = np.maximum(start[mine], begin), np.minimum(start[mine] + n[mine], end)
                some = lo < hi
                if not some.any():
                    continue
                k, leaf, lo, hi = mine[some], leaf[some], lo[some], hi[some]
                # tokens of the tree are counted from the first phase on, those of other queues from this one
                base = np.full(len(k), 0 if pool else begin)
                window = pool.window if pool else lambda _, t, p=p, q=q: p.window(q, t)
                given = pool.given if pool else lambda _, w, p=p, q=q: p.given(q, w)
                a, z = lo - base, hi - base
                w0 = window(leaf, a)
                each = window(leaf, z - 1) - w0 + 1
                w = np.repeat(w0 - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                k, leaf, base, a, z = (np.repeat(x, each) for x in (k, leaf, base, a, z))
                mine = given(leaf, w)
                s, e = np.maximum(a, mine), np.minimum(z, given(leaf, w + 1))
                before = sum((p.given(x, w + 1) - p.given(x, w) for x in range(q)), np.zeros(len(w), np.int64))
                if pool:
                    before = before + tree.before(leaf, pool.root(w), pool.root(w + 1))
                some = s < e
                row.append(k[some])
                first.append((s + base - start[k])[some].astype(np.int64))
                size.append((e - s)[some].astype(np.int64))
                seq.append((w + p.base)[some])
                offset.append((before + s - mine)[some].astype(np.int64))
        if not row:
            continue
        row, first, size, seq, offset = map(np.concatenate, (row, first, size, seq, offset))
        order = np.lexsort((first, row))
        row, first, size, seq, offset = (x[order] for x in (row, first, size, seq, offset))
        crc, cut, last, data = [], [], -1, None
        for r, f, m in zip(row.tolist(), first.tolist(), size.tolist(), strict=True):
            if r != last:
                data, last = memoryview(ids[r].as_buffer()), r
            piece = data[4 * f : 4 * (f + m)]
            crc.append(zlib.crc32(piece))
            if with_ids:
                cut.append(np.frombuffer(piece, np.uint32).astype(np.int32))
        columns = [doc_id.take(pa.array(row)), pa.array(first), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq.astype(np.int64)), pa.array(offset)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns, names = [*columns, pa.array(cut, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)


def pack_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mixture: dict | float | None = None, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids).

    mixture: target shares by source; the sources that it doesn't name share what is left as the corpus has them. A number
    is a temperature: each source's target is in proportion to its tokens raised to this power. Without a mixture each
    source's target is its share of the corpus.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"))
    sizes = rows.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    ranked = [r["source"] for r in sizes.orderBy(F.desc("bytes"), F.asc_nulls_first("source")).collect()]
    named = [x for k, x in enumerate(ranked) if k < QUEUES - 1 or (isinstance(mixture, dict) and x in mixture)]
    direct, other = set(named), len(named)
    queues = {x: k for k, x in enumerate([*named, *[x for x in ranked if x not in direct]])}
    made = rows.mapInArrow(lambda it: _tokens(it, path, queues), "doc_id long, queue int, part int, start long, n long, ids binary")
    made = scratch.materialize(made, "tokens")
    sums = made.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    each = [0] * len(queues)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        each[r["queue"]] = r["n"]
    tree = Tree(each[other:]) if len(queues) > other else None
    totals = [*each[:other], tree.total if tree else 0]
    target = None
    if isinstance(mixture, (int, float)):
        target = [float(t) ** mixture for t in totals[:other]] + [float(np.sum(np.array(each[other:], float) ** mixture))]
    elif mixture:
        asked = [mixture.get(s) for s in named] + [None]
        left = max(0.0, 1.0 - sum(x or 0.0 for x in asked))
        rest = sum(t for t, x in zip(totals, asked, strict=True) if x is None) or 1
        target = [left * t / rest if x is None else float(x) for t, x in zip(totals, asked, strict=True)]
    plan = phases(totals, target, length)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = scratch.materialize(starts, "starts")
    if starts.count() <= BROADCAST_ROWS:  # a row for each task and queue; beyond that size the join shuffles
        starts = F.broadcast(starts)
    placed = made.join(starts, ["queue", "part"]).withColumn("start", F.col("start") + F.col("base")).select("doc_id", "queue", "start", "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return placed.mapInArrow(lambda it: _pieces(it, plan, with_ids, other, tree), schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Targets: the sources' tokens to the power TEMPERATURE, so small sources weigh more than their share."""
    return pack_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), mixture=TEMPERATURE, with_ids=False)

"""Vectorised words, hashes and n-grams over Arrow string arrays.

Texts are handled as UTF-8 bytes: all word classes here are ASCII classes or their complements, so a byte table
decides membership and no text is decoded. Work goes in chunks of bounded size; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
CHUNK = 1 << 20
PIECE = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix finaliser), other for each seed."""
    x = x + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for hashes is faster than numpy's own way by hash tables."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


#: ``[^\x20\x09-\x0D]``: all but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Masks of the first k bytes of an eight-byte lane.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * kind().itemsize).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` bytes, or one text."""
    _, off = buffers(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    buf: np.ndarray  # the texts' bytes, a blank after each text
    starts: np.ndarray
    ends: np.ndarray  # exclusive
    first: np.ndarray  # index of each text's first word, and the number of words
    _wide: np.ndarray | None = None  # the eight bytes from each place on

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word the words from it to its text's end, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def lanes(self, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(words lo .. hi-1 as eight-byte lanes end to end, the last of each filled up with zeros; lanes of each word)."""
        starts, ends = self.starts[lo:hi], self.ends[lo:hi]
        if self._wide is None:
            self._wide = np.ndarray((len(self.buf),), "<u8", np.append(self.buf, np.zeros(8, np.uint8)), strides=(1,))
        size = ends - starts
        n = (size + 7) >> 3
        if n.max(initial=0) <= 1:
            return self._wide[starts] & _MASK[size], n
        at = np.cumsum(n) - n
        place = 8 * (np.arange(int(n.sum())) - np.repeat(at, n))
        return self._wide[np.repeat(starts, n) + place] & _MASK[np.minimum(np.repeat(size, n) - place, 8)], n

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word; hashes of different seeds have nothing in common.

        Each lane goes through a mixer keyed by its place and the seed before lanes are summed, so no arrangement of
        bytes cancels out whatever the rest of the word is.
        """
        out = np.empty(len(self), U)
        size = np.cumsum(self.ends - self.starts)
        lo = 0
        while lo < len(out):  # in pieces, so that the lanes stay in the cache
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, "right")))
            v, n = self.lanes(lo, hi)
            if len(v) == len(n):
                v = mix(mix(v, 4 * seed + 1), 4 * seed + 2)
            else:
                at = np.cumsum(n) - n
                place = (np.arange(len(v)) - np.repeat(at, n)).astype(U)
                v = np.add.reduceat(mix(mix(v, 4 * seed + 1) + place * _GOLD, 4 * seed + 2), at)
            out[lo:hi] = mix(v + (self.ends[lo:hi] - self.starts[lo:hi]).astype(U) * _GOLD, 4 * seed + 3)
            lo = hi
        return out

    def text_of(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words joined by one blank."""
        s, e = self.starts[keep], self.ends[keep]
        kept = np.concatenate([[0], np.cumsum(keep)])[self.first]
        n = np.diff(kept)
        step = np.zeros(len(self.buf) + 2, np.int8)
        step[s] += 1
        stop = e + 1
        last = kept[1:][n > 0] - 1
        stop[last] -= 1
        np.subtract.at(step, stop, 1)
        out = self.buf.copy()
        out[e] = 32
        data = out[np.cumsum(step[: len(out)], dtype=np.int32) > 0]
        size = np.concatenate([[0], np.cumsum(e - s + 1)])
        length = np.where(n > 0, size[kept[1:]] - size[kept[:-1]] - 1, 0)
        off = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


#: Lines: runs of anything but line feeds.
LINES = np.ones(256, bool)
LINES[0x0A] = False


def words(texts: pa.Array, table: np.ndarray = SPACED, fold: bool = False, blank: int = 32) -> Words:
    """Words of each text by a byte table, after folding A-Z if asked. blank: a byte that no word has."""
    raw, off = buffers(texts)
    buf = np.insert(raw, off[1:], np.uint8(blank))
    if fold:
        buf = LOWER[buf]
    inside = table[buf]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Words(buf, starts, ends, np.searchsorted(starts, off + np.arange(len(off))))


def _join(a: np.ndarray, b: np.ndarray, salt: U) -> np.ndarray:
    x = a * salt + b
    x ^= x >> U(32)
    x *= _M1
    x ^= x >> U(29)
    return x


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    if k < len(x):
        out[: len(x) - k] = x[k:]
    return out


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of the k words from each word on, by doubling; without meaning where fewer are left in the text."""
    salt = U((0xA0761D6478BD642F + 2 * seed * 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF)
    res, done, cur, p = None, 0, h, 1
    while k:
        if k & 1:
            res = cur if res is None else _join(res, _ahead(cur, done), salt)
            done += p
        k >>= 1
        if k:
            cur = _join(cur, _ahead(cur, p), salt)
            p *= 2
    return res

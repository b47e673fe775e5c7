"""Fingerprints against a plain version of the sampling, and their likeness against the generalised Jaccard similarity."""

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

from srcweave.llm import fingerprints as P

U = 1 << 64


def _long(h, v, size=8):
    return xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), h)


def _samples(text, samples=P.SAMPLES):
    """ln a of the sampled term for each sample, as 32-bit floats."""
    weights = collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    if not weights:
        return None
    out = []
    for k in range(samples):
        best = None
        for word, s in weights.items():
            term = xxhash.xxh64_intdigest(word.encode(), 42)
            term -= U if term >> 63 else 0
            g, j = divmod(k, P.GROUP)
            h = [_long(_long(_long(42, term), g, 4), 2 * j + i, 4) for i in (0, 1)]
            low = lambda x, shift: ((x >> shift & (1 << 26) - 1) + 0.5) * 2.0**-26
            r, c = (-math.log(low(x, 0) * low(x, 38)) for x in h)
            b = ((h[0] >> 26 & 0xFFF) * 4096 + (h[1] >> 26 & 0xFFF)) * 2.0**-24
            t = np.rint(math.log(s) / r + b - 0.5)
            a = math.log(c) - r * (t - b + 1)
            best = a if best is None or a < best else best
        out.append(np.float32(best))
    return out


def _plain(rows):
    """(doc_id, n_chars, edited text, text, next text) of distinct ids, in a ring of descending ids."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        need = len(t) // 3
        yield i, len(t), t[: len(t) - need] + after[:need], t, after


def _similar(a, b):
    a, b = (collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (a, b))
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_against_plain(spark, rows):
    some = list({i: t for i, t in rows if i is not None}.items())[:60] + [(9006, "é" * 50), (9007, "x " * 3000), (9012, "w" * 5000 + " " + "y z " * 40), (9002, ""), (9003, " \t "), (9005, "a b c"), (None, "no id")]
    some = list({i: t for i, t in some}.items())
    df = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 as k1", "2 as head", "3 as n", "4 as g").repartition(5)
    got = {r.doc_id: r for r in P.fingerprints(df).collect()}
    assert len(got) == len(some)
    gap, n, off = 0.0, 0, 0
    for i, n_chars, edited, text, after in _plain(some):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n_chars, hashlib.sha256(edited.encode()).hexdigest())
        for print_, t in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            want = _samples(t)
            assert len(print_) == (8 * P.SAMPLES if want else 0)
            if want:
                off += sum(print_[8 * k : 8 * k + 8] != f"{xxhash.xxh64_intdigest(v.tobytes(), 42) & 0xFFFFFFFF:08x}" for k, v in enumerate(want))
        assert r.near_next == _share(r.fingerprint, got[_next(some, i)].fingerprint) and r.near_edited == _share(r.fingerprint, r.edited_fingerprint)
        if text.strip() and edited.strip():
            gap += r.near_edited - _similar(text, edited)
            assert abs(r.near_edited - _similar(text, edited)) < 5 * 0.5 / math.sqrt(P.SAMPLES)
            n += 1
    assert off <= 2  # logarithms of other libraries may differ in the last bit
    assert abs(gap / n) < 4 * 0.5 / math.sqrt(P.SAMPLES * n)


def _next(rows, i):
    ids = sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))
    return ids[(ids.index(i) + 1) % len(ids)]


def _share(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / P.SAMPLES


def test_collisions_follow_weights(spark):
    """One term of weights s and t: the smaller over the larger."""
    terms = spark.range(400).selectExpr("id as k1", "0L as k2", "xxhash64(id) as term", "3 as a", "4 as b", "12 as c")
    rows = P.drawn(terms, ("a", "b", "c")).collect()
    same = lambda x, y: np.mean([p == q for r in rows for p, q in zip(r[x], r[y], strict=True)])
    assert abs(same("a", "b") - 3 / 4) < 0.03 and abs(same("a", "c") - 3 / 12) < 0.03 and abs(same("b", "c") - 4 / 12) < 0.03


def test_ties_repeats_nulls_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (1, "others"), (5, "a b c d e f")], "doc_id long, text string")
    got = P.fingerprints(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2, 5]
    prints = {r.fingerprint for r in got if r.n_chars == 11}
    assert len(prints) == 1 and next(r for r in got if r.doc_id == 2).fingerprint == ""
    one = P.fingerprints(df.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    assert P.fingerprints(df.where("false")).collect() == []


def test_very_long_text(spark):
    text = " ".join(f"w{k % 7919}" for k in range(600_000))
    got = P.fingerprints(spark.createDataFrame([(2, text), (1, "tail of it")], "doc_id long, text string")).collect()
    assert next(r for r in got if r.doc_id == 2).n_chars == len(text) and next(r for r in got if r.doc_id == 2).near_edited > 0.4

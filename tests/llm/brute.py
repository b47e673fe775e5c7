"""Plain versions of operators, for comparing whole results."""

import collections
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _bucket(*parts, of=1 << 16):
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode(), seed)
    return (seed - (1 << 64) if seed >> 63 else seed) % of


def grams(text):
    w = WORD.findall(text)
    ends = [x[-3:] for x in w]
    return [_bucket(x) for x in w] + [_bucket(*x) for x in zip(ends, ends[1:], strict=False)] + [_bucket(x) for x in ends[-1:]]  # the last word makes a pair with nothing


def quality(rows, trusted, prior=20_000.0, buckets=1 << 16, threshold=-0.2):
    """[(score, kept)] of rows (id, text): log-likelihood ratios of hashed n-grams, and the base rules."""
    every = [grams(t) for _, t in rows]
    raw = collections.Counter(b for g in every for b in g)
    target = collections.Counter(b for (i, _), g in zip(rows, every, strict=True) if i in trusted for b in g)
    n, m, weight = sum(raw.values()), sum(target.values()), {}
    for b, k in raw.items():
        p = (k + 1) / (n + buckets)
        weight[b] = math.log((target[b] + prior * p) / (m + prior) / p) if m else 0.0
    out = []
    for (_, t), g in zip(rows, every, strict=True):
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        score = sum(weight[b] for b in g) / (2 * len(w)) if w else 0.0
        out.append((score, not (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and score >= threshold))
    return out


def contaminated(rows, items):
    """Whether any window of ten item words, or a whole shorter item, stands in the text."""
    split = lambda t: ALNUM.findall((t or "").translate(FOLD))
    windows = {tuple(w[k : k + 10]) for w in map(split, items) if w for k in range(max(len(w) - 9, 1))}
    sizes = {len(x) for x in windows}
    return [any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)) for w in (split(t) for _, t in rows)]

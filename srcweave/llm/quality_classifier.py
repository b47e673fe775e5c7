"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from; negatives are never shown. With the class prior pi
and a logistic loss l, the linear model g minimises the non-negative unbiased risk

    pi * E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - pi * E_p[l(g, -1)])

and while the second part is negative its gradient is followed upwards. The prior is estimated first: a classifier of
positives against a sample of at most ``GROUP`` unlabelled rows of one half ranks held-back positives and all rows of the
other half, and pi is the ratio of
the shares of unlabelled and of positive rows above the threshold for which that ratio's upper confidence bound is least.

Features of a whole text: shares of character classes, word statistics, repeated words and lines, and hashed word
endings. Labels, language, source and id are no features. They are made once and written. At most ``POSITIVES`` labelled
rows are learnt from, those with the smallest hashes of their ids. The scale of the features and the unlabelled side of
the prior are sums over all rows; what ranks for the prior is learnt from the samples named above. For the risk all rows
are dealt by hash into groups of about ``GROUP`` rows; each group's risk, of its rows and the positives, is minimised in a
task of its own (by a fixed number of steps), and the model is the mean of their weights by numbers of rows. Up to
``GROUP`` rows there is one group; beyond that every row has the same part in the model, but a mean of minima isn't the
minimum over all rows. One sum for each weight comes to the driver. Every row is scored, with a
model of some KB that rides along; scoring needs no shuffle.

Cases: a null or empty text has zero features and a score like any; repeated rows are scored each; without positives
or rows to fit on, every score is 0.5; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans import scratch
from .textkit import LINES, SPACED, buffers, chunks, mix, words

POSITIVES = 6_000
GROUP = 12_000
BINS = 4096  # of outputs of the first classifier, for the prior
ENDINGS = 512
DENSE = 14
THRESHOLD = 0.7
RIDGE = 80.0  # chosen on a fold of the training rows, never on held-out ones
U = np.uint64


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, s in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!?", ".,;:", "\n"), 1):
        table[[ord(c) for c in s]] = k
    table[128:] = 7
    return table


_CLASS = _classes()


def _distinct(w, h: np.ndarray) -> np.ndarray:
    """For each text the number of its distinct words."""
    doc = w.doc()
    order = np.lexsort((h, doc))
    a, d = h[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(w.counts))


def features(texts: pa.Array) -> np.ndarray:
    """A row of DENSE + ENDINGS numbers for each text."""
    m = len(texts)
    raw, off = buffers(texts)
    w = words(texts, SPACED)
    h, n, doc = w.hashes(), w.counts, w.doc()
    size = np.maximum(np.diff(off), 1)
    byte_doc = np.repeat(np.arange(m), np.diff(off))
    kinds = np.bincount(byte_doc * 8 + _CLASS[raw], minlength=8 * m).reshape(m, 8)[:, 1:] / size[:, None]
    some = np.maximum(n, 1)
    same = lambda k: np.bincount(doc[:-k][(h[:-k] == h[k:]) & (doc[:-k] == doc[k:])], minlength=m) / some if len(h) > k else np.zeros(m)
    lines = words(texts, LINES, blank=10)
    out = np.zeros((m, DENSE + ENDINGS), np.float32)
    out[:, :7] = np.log1p(50 * kinds)
    out[:, 7] = np.log1p(50 * same(1))
    out[:, 8] = np.log1p(50 * same(2))
    out[:, 9] = 1 - _distinct(w, h) / some
    out[:, 10] = np.log1p(n)
    out[:, 11] = np.log1p(size / some)
    out[:, 12] = 1 - _distinct(lines, lines.hashes()) / np.maximum(lines.counts, 1)
    out[:, 13] = n < 10
    if len(h):
        last = [w.buf[np.maximum(w.ends - k, 0)].astype(U) for k in (1, 2, 3)]
        bucket = (mix(last[0] | last[1] << U(8) | last[2] << U(16)) % U(ENDINGS)).astype(np.int64)
        out[:, DENSE:] = np.sqrt(np.bincount(doc * ENDINGS + bucket, minlength=m * ENDINGS).reshape(m, ENDINGS) / some[:, None])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(x: np.ndarray, slope, steps: int = 300, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Adam over a risk given by its slope in the model's outputs, with a ridge that weakens as rows grow in number."""
    decay = RIDGE / len(x)
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        s = slope((x @ w.astype(x.dtype)).astype(float) + b)  # in the rows' own precision: a mixed product copies them at every step
        g = np.append(x.T @ s.astype(x.dtype) + decay * w, s.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def ranking(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias) that tell positives from unlabelled rows, both standardised, and outputs of a quarter of the
    positives that was held back from it."""
    p = np.arange(len(positive)) % 4 == 0
    x = np.concatenate([positive[~p], unlabelled])
    y = np.arange(len(x)) < int((~p).sum())
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    w, b = _descend(x, lambda g: weight * (_sigmoid(g) - y), steps=150)
    return w, b, positive[p] @ w + b


def bin_of(outputs: np.ndarray) -> np.ndarray:
    return np.clip((_sigmoid(outputs) * BINS).astype(np.int64), 0, BINS - 1)


def prior_from(positive: np.ndarray, counts: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from outputs of held-back positives and all others' counts by bin."""
    at = np.unique(np.quantile(bin_of(positive), np.linspace(0, 0.8, 81)).astype(np.int64))
    own = np.bincount(bin_of(positive), minlength=BINS)
    above = lambda c: (np.cumsum(c[::-1])[::-1] / max(c.sum(), 1))[at]
    kept = np.maximum(above(own), 1e-9)
    ratio = above(counts) / kept
    doubt = sum(np.sqrt(np.log(40) / (2 * max(n, 1))) for n in (len(positive), counts.sum())) / kept
    return float(np.clip(ratio[np.argmin(ratio + doubt)], 0.02, 0.98))


def risk(outputs_p: np.ndarray, outputs_u: np.ndarray, pi: float) -> tuple[float, np.ndarray]:
    """(the non-negative risk without its ridge, its slope in the outputs); where the second part is negative, the slope
    of what is followed instead."""
    p, u = len(outputs_p), len(outputs_u)
    lose = lambda g, y: np.logaddexp(0, -y * g).mean()
    q, r = _sigmoid(outputs_p), _sigmoid(outputs_u)
    rest = lose(outputs_u, -1) - pi * lose(outputs_p, -1)
    total = pi * lose(outputs_p, 1) + max(0.0, rest)
    if rest >= 0:
        return total, np.concatenate([pi * (q - 1) / p - pi * q / p, r / u])
    return total, np.concatenate([pi * q / p, -r / u])  # the estimate fell below zero: climb out of it


def minimum(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) of the least risk over the rows given, standardised."""
    n = len(positive)
    return _descend(np.concatenate([positive, unlabelled]), lambda g: risk(g[:n], g[n:], prior)[1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model of rows that are all at hand."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-2
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    if prior is None:
        told = [ranking(p, u[h::2]) for h in (0, 1)]
        outputs = np.concatenate([u[1 - h :: 2] @ w + b for h, (w, b, _) in enumerate(told)])
        prior = prior_from(np.concatenate([x for *_, x in told]), np.bincount(bin_of(outputs), minlength=BINS))
    return Model(mean, scale, *minimum(p, u, prior), prior)


_WIDE = DENSE + ENDINGS


def _matrix(column: pa.Array) -> np.ndarray:
    raw, _ = buffers(column.cast(pa.large_binary()).view(pa.large_string()))
    return raw.view(np.float32).reshape(len(column), _WIDE)


def _made(rows: DataFrame) -> DataFrame:
    """(doc_id, o: a hash of id and row number, so that copies spread, x: features) of every row, written once."""

    def run(it):
        for b in it:
            for lo, hi in chunks(b.column("text")):
                x = features(b.column("text").slice(lo, hi - lo))
                off = np.arange(0, 4 * _WIDE * (hi - lo) + 1, 4 * _WIDE, dtype=np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("o").slice(lo, hi - lo), data], ["doc_id", "o", "x"])

    return scratch.materialize(rows.withColumn("o", F.xxhash64("doc_id", F.monotonically_increasing_id())).mapInArrow(run, "doc_id long, o long, x binary"), "features")


def _sample(made: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of the rows with the given ids (at most ``most`` ids, and rows)."""
    few = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = made.join(F.broadcast(few), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", "x"), "x").limit(most).select("x").collect()
    return np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), _WIDE)


def _sums(made: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``fn`` (features to ``size`` numbers) over all rows."""

    def run(it):
        total = np.zeros(size)
        for b in it:
            for lo in range(0, b.num_rows, 2048):
                total += fn(_matrix(b.column("x").slice(lo, 2048)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["i", "v"])

    out = np.zeros(size)
    for r in made.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _averaged(made: DataFrame, positive: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float, rows: int) -> Model:
    """The mean of the models of all groups of rows."""
    groups, shared = max(1, math.ceil(rows / GROUP)), made.sparkSession.sparkContext.broadcast(positive)

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x").combine_chunks())
        w, b = minimum(shared.value, ((x - mean) / scale).astype(np.float32), prior)
        return pa.table({"i": pa.array(np.arange(len(w) + 1)), "v": pa.array(np.append(w, b) * len(x))})

    sums = made.select(F.pmod("o", F.lit(groups)).alias("g"), "x").groupBy("g").applyInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(_WIDE + 1)
    for r in sums.collect():
        out[r["i"]] = r["v"] / rows
    return Model(mean, scale, out[:-1], float(out[-1]), prior)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def quality_classifier(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, score). positives: one column with the ids of trusted documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = _made(rows)
    n, trusted = made.count(), _sample(made, positives.toDF("doc_id"), POSITIVES)
    model = _model(made, trusted, n) if len(trusted) and n else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        model = shared.value
        for b in it:
            score = model.score(_matrix(b.column("x"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return made.mapInArrow(run, "doc_id long, score double")


def _model(made: DataFrame, trusted: np.ndarray, n: int) -> Model:
    moments = lambda x: np.concatenate([x.sum(axis=0, dtype=float), (x.astype(float) ** 2).sum(axis=0)])
    sums = (_sums(made, moments, 2 * _WIDE) + moments(trusted)) / (n + len(trusted))
    mean = sums[:_WIDE]
    scale = np.sqrt(np.maximum(sums[_WIDE:] - mean**2, 0)) + 1e-2
    standard = lambda x: ((x - mean) / scale).astype(np.float32)
    counts, held = np.zeros(BINS), []
    for half in (0, 1):  # told from a sample of one half of the rows, counted over the whole other half
        own = F.pmod("o", F.lit(2)) == half
        w, b, x = ranking(standard(trusted), standard(_sample(made.where(own), made.select("doc_id"), GROUP)))
        counts += _sums(made.where(~own), lambda x, w=w, b=b: np.bincount(bin_of(standard(x) @ w + b), minlength=BINS).astype(float), BINS)
        held.append(x)
    return _averaged(made, standard(trusted), mean, scale, prior_from(np.concatenate(held), counts), n)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    positives = labels.where((F.col("quality") == 1) & ~held_out("doc_id")).select("doc_id")
    scored = quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), positives)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""The positive-unlabelled classifier: prior, risk and held-out accuracy."""

import math

import numpy as np


def test_prior_and_risk_on_known_mixtures():
    from srcweave.llm.quality_classifier import fit

    rng = np.random.default_rng(4)
    for pi in (0.3, 0.6, 0.85):
        pos, neg = rng.normal(1.5, 1, (3000, 5)), rng.normal(-1.5, 1, (3000, 5))
        take = rng.random(3000) < pi
        m = fit(pos[:1500], np.where(take[:, None], rng.normal(1.5, 1, (3000, 5)), neg))
        assert abs(m.prior - pi) < 0.08
        assert (m.score(pos[1500:]) >= 0.5).mean() > 0.95 and (m.score(neg) < 0.5).mean() > 0.95


def test_held_out_accuracy(spark, sf_dir):
    from srcweave.llm.quality_classifier import op4_quality_classifier

    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in op4_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_every_row_is_scored(docs, rows, empty, spark):
    from srcweave.llm.quality_classifier import quality_classifier

    ids = spark.createDataFrame([(i,) for i in range(0, 120)], "doc_id long")
    got = quality_classifier(docs, ids).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    nobody = quality_classifier(docs, ids.where("false")).collect()
    assert all(r.score == 0.5 for r in nobody) and len(nobody) == len(rows)
    assert quality_classifier(empty, ids).count() == 0


def test_features_by_plain_python(rows):
    """The same numbers from Python strings, text by text."""
    import re

    import pyarrow as pa
    from srcweave.llm.quality_classifier import DENSE, ENDINGS, features
    from srcweave.llm.textkit import mix

    texts = [t for _, t in rows]
    got = features(pa.array(texts))
    kinds = ["[A-Z]", "[0-9]", r"[#*$%&|<>]", "[!?]", "[.,;:]", "\n"]
    for t, x in zip(texts, got, strict=True):
        raw = t.encode()
        w, size = re.findall(rb"[^\x20\x09-\x0D]+", raw), max(len(raw), 1)
        n = max(len(w), 1)
        counts = [len(re.findall(k.encode(), raw)) for k in kinds] + [sum(c > 127 for c in raw)]
        want = [math.log1p(50 * c / size) for c in counts]
        want += [math.log1p(50 * sum(a == b for a, b in zip(w, w[k:], strict=False)) / n) for k in (1, 2)]
        lines = [y for y in raw.split(b"\n") if y]
        want += [1 - len(set(w)) / n, math.log1p(len(w)), math.log1p(size / n), 1 - len(set(lines)) / max(len(lines), 1), float(len(w) < 10)]
        assert np.allclose(x[:DENSE], want, atol=1e-5), t[:50]
        assert abs((x[DENSE:].astype(float) ** 2).sum() - (len(w) > 0)) < 1e-4
    for word in ("cat", "longer"):
        a, b, c = word.encode()[-1:-4:-1]
        bucket = int(mix(np.array([a | b << 8 | c << 16], np.uint64))[0] % np.uint64(ENDINGS))
        assert features(pa.array([f"{word} {word}"]))[0, DENSE + bucket] == 1


def test_slope_of_the_risk_by_finite_differences():
    from srcweave.llm.quality_classifier import risk

    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 2, 7), rng.normal(-1, 2, 11)
    total, slope = risk(p, u, 0.1)
    assert np.logaddexp(0, u).mean() > 0.1 * np.logaddexp(0, p).mean()
    g = np.concatenate([p, u])
    for k in range(len(g)):
        up, down = g.copy(), g.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((risk(up[:7], up[7:], 0.1)[0] - risk(down[:7], down[7:], 0.1)[0]) / 2e-6 - slope[k]) < 1e-6
    lower = risk(p + 5, u - 9, 0.9)[1]  # the second part is negative: its own slope, turned round
    rest = lambda a, b: np.logaddexp(0, b).mean() - 0.9 * np.logaddexp(0, a).mean()
    assert rest(p + 5, u - 9) < 0
    for k in range(3):
        a = p + 5
        a[k] += 1e-6
        assert abs((rest(a, u - 9) - rest(p + 5, u - 9)) / 1e-6 + lower[k]) < 1e-5


def test_the_minimum_is_stationary():
    """Where the second part is positive, the slope in the weights vanishes but for the steps' length."""
    from srcweave.llm import quality_classifier as Q

    rng = np.random.default_rng(9)
    pos, every = rng.normal(0.8, 1, (400, 3)), np.concatenate([rng.normal(0.8, 1, (600, 3)), rng.normal(-0.8, 1.3, (2400, 3))])
    w, b = Q.minimum(pos, every, 0.2)
    value, s = Q.risk(pos @ w + b, every @ w + b, 0.2)
    assert value > 0.2 * np.logaddexp(0, -(pos @ w + b)).mean()
    decay = Q.RIDGE / (len(pos) + len(every))
    assert np.abs(pos.T @ s[:400] + every.T @ s[400:] + decay * w).max() < 5e-3 and abs(s.sum()) < 5e-3


def test_every_row_has_its_part_in_the_model(spark, monkeypatch):
    """Groups share out all rows; the model is the mean of theirs, whatever the tasks."""
    import pyarrow as pa
    from srcweave.llm import quality_classifier as Q

    monkeypatch.setattr(Q, "GROUP", 40)
    texts = [f"word{k % 7} is here {'!' * (k % 5)} and there" for k in range(150)]
    made = Q._made(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    x = Q.features(pa.array(texts))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    got = Q._averaged(made, (x[:20] - mean) / scale, mean, scale, 0.4, 150)
    group = {r.doc_id: r.o % 4 for r in made.select("doc_id", "o").collect()}
    assert len(group) == 150 and len(set(group.values())) == 4
    want = np.zeros(x.shape[1] + 1)
    for g in range(4):
        rows = [k for k in range(150) if group[k] == g]
        w, b = Q.minimum((x[:20] - mean) / scale, ((x[rows] - mean) / scale).astype(np.float32), 0.4)
        want += np.append(w, b) * len(rows) / 150
    assert np.allclose(np.append(got.weights, got.bias), want, atol=2e-3)


def test_prior_counts_every_row(spark, monkeypatch):
    """Sums over all rows, in small batches and tasks, equal those of one array."""
    import pyarrow as pa
    from srcweave.llm import quality_classifier as Q

    texts = [f"word{k % 7} is here {'!' * (k % 5)}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    made = Q._made(docs)
    x = Q.features(pa.array(texts))
    assert np.allclose(Q._sums(made, lambda m: m.sum(axis=0).astype(float), x.shape[1]), x.sum(axis=0), rtol=1e-4) and made.count() == 300

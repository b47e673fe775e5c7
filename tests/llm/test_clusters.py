"""Clustering against plain Lloyd rounds, and the trees against their definitions."""

import hashlib

import numpy as np
import pytest

from srcweave.llm import centroid_clustering as C


def _points(seed, n, d=8, groups=6, spread=3):
    dice = np.random.default_rng(seed)
    x = dice.integers(-60, 60, (groups, d))[dice.integers(0, groups, n)] + dice.integers(-spread, spread + 1, (n, d))
    return x.astype(np.int64)


@pytest.mark.parametrize(("seed", "n", "groups", "spread"), [(1, 500, 6, 3), (2, 300, 300, 50), (3, 40, 1, 0), (4, 700, 3, 1), (5, 1, 1, 1)])
def test_trees(seed, n, groups, spread):
    x = np.unique(_points(seed, n, groups=groups, spread=spread), axis=0)
    tree = C.cover_tree(x, 4)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.centre)):
        own = tree.order[tree.first[k] : tree.last[k]]
        assert tree.centre[k] in own and np.sqrt(C.squares(x[own], x[tree.centre[k]])).max() <= tree.radius[k] + 1e-9
        kids = range(tree.child[k], tree.end[k])
        if kids:
            assert tree.centre[kids[0]] == tree.centre[k] and sum(tree.last[j] - tree.first[j] for j in kids) == len(own)
            between = [np.sqrt(C.squares(x[tree.centre[i]], x[tree.centre[j]])) for i in kids for j in kids if i < j]
            assert min(between, default=np.inf) > tree.radius[k] / 2 >= max(tree.radius[j] for j in kids) - 1e-9
    c = _points(seed + 50, 9, groups=9, spread=40)
    c = C._Centroids([*c.tolist(), *c[:3].tolist(), x[0].tolist()])
    whole, owner = C.dual_tree(x, tree, c.x, c.tree)
    want = np.argmin(C.squares(x[:, None], c.x[None]), axis=1)
    assert (owner == want[tree.order]).all()
    counted = np.zeros(len(c.x), int)
    for a, z, o in whole:
        counted[o] += z - a
        assert (owner[a:z] == o).all()
    assert (counted == np.bincount(want, minlength=len(c.x))).all()


def test_pruning_spares_work(monkeypatch):
    x = np.unique(_points(7, 4000, groups=12, spread=1), axis=0)
    tree, c = C.cover_tree(x), C._Centroids(_points(8, 16, groups=16, spread=0).tolist())
    done = [0]
    real = C.squares

    def counting(a, b):
        out = real(a, b)
        done[0] += out.size
        return out

    monkeypatch.setattr(C, "squares", counting)
    C.dual_tree(x, tree, c.x, c.tree)
    assert done[0] < 0.3 * len(x) * len(c.x)


def _plain(rows, k=16, rounds=3):
    kept = [(i, np.clip(np.floor(64 * np.array(v, float)), -C.MOST, C.MOST).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    x = np.array([v for _, v in kept])
    first = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"1:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), x[r].tolist()))[:k]
    c = x[first]
    for t in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = np.argmin(d, axis=1)
        if t < rounds:
            c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    best = d[np.arange(len(x)), own]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return [(i, int(o), int(b), int(best[own == o].sum()), int(best.sum()), sha[o]) for (i, _), o, b in zip(kept, own, best, strict=True)]


def _rows():
    dice = np.random.default_rng(11)
    base = dice.normal(0, 0.2, (5, 64))
    rows = [(i, (base[i % 5] + dice.normal(0, 0.01, 64)).tolist()) for i in range(120)]
    rows += [(200 + i, base[0].tolist()) for i in range(40)]  # copies
    odd = base[1].tolist()
    return [*rows, (7, rows[3][1]), (None, rows[4][1]), (300, None), (301, []), (302, odd[:63]), (303, [None, *odd[1:]]), (304, [float("nan"), *odd[1:]]), (305, [float("inf"), *odd[1:]]), (306, [*odd, 1.0])]


@pytest.mark.parametrize("few", [0, 3, 40, None])
def test_rounds(spark, few):
    rows = _rows()[:few]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as ids", "2 as x", "3 as cluster").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, C.cluster(df).collect()), key=key) == sorted(_plain(rows), key=key)


def test_small_blocks_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    rows = _rows()[:50] + [(400, [3e300] + [0.0] * 63), (401, [-3e300] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, C.cluster(df).collect()), key=key) == sorted(_plain(rows), key=key)

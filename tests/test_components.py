"""Connected components against a plain search, by rounds over tables and finished in one task."""

import random

import pytest

from srcweave.operators.components import connected_components


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for v in sorted(near):
        todo = [] if v in out else [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo += near[x]
    return out


def graphs():
    r = random.Random(7)
    path = [(i, i + 1) for i in range(60)]
    r.shuffle(path)
    star = [(500, x) for x in range(400, 450)]
    loose = [(r.randrange(1000, 1120), r.randrange(1000, 1120)) for _ in range(70)]
    return [*path, *star, *loose, (5, 5), (None, 3), (3, None), (0, 1), (1, 0)]


@pytest.mark.parametrize("local_edges", [0, 100_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind, local_edges):
    edges = [tuple(x if x is None or kind == "long" else f"ä{x}" for x in e) for e in graphs()]
    got = connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), "a", "b", local_edges).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: r["component"] for r in got} == plain(edges)


@pytest.mark.parametrize("local_edges", [0, 100_000])
def test_no_edges(spark, local_edges):
    assert connected_components(spark.createDataFrame([(1, 1)], "src long, dst long"), local_edges=local_edges).count() == 0

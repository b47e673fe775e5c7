"""Jaccard join against all pairs."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _shingles(t):
    w = tuple(WORD.findall((t or "").translate(FOLD)))
    return {w[i : i + 5] for i in range(len(w) - 4)} or ({w} if w else set())


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return [(str(i), len(sets[k]), str(least[find(k)])) for k, (i, _) in enumerate(rows)]


def test_jaccard_components(docs, rows, empty):
    from srcweave.llm.jaccard_join import jaccard_components

    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs).collect())
    assert got == sorted(_components(rows))
    assert jaccard_components(empty).count() == 0


def test_chains_groups_and_boundaries(spark):
    from srcweave.llm.jaccard_join import jaccard_components

    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{g}x{rng.randrange(50)}" for _ in range(60 + 10 * g)]
        for _ in range(rng.randrange(2, 25)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
            if rng.random() < 0.3:
                base = t  # a chain
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(2000 + k, shared + " " + " ".join(f"q{k}z{j}" for j in range(rng.randrange(1, 30)))) for k in range(40)]
    rows += [(3000, "a b c"), (2999, "A B C"), (3001, "a b"), (3002, ""), (3003, ""), (3004, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs).collect())
    assert got == sorted(_components(rows))


def test_crowded_regions_in_parts(spark, monkeypatch):
    """Regions of many documents that no pivot settles, cut into small parts at once, lose no link."""
    from srcweave.llm import jaccard_join as J

    monkeypatch.setattr(J, "PART", 3)
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(70):  # all hold one passage, and differ in about a fifth of their shingles
        own = [f"o{rng.randrange(12)}x{j}" for j in range(rng.randrange(2, 14))]
        rows.append((k, " ".join(own[: len(own) // 2] + shared + own[len(own) // 2 :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(_components(rows))
    assert 1 < len({c for *_, c in want}) < 70
    for rounds in (1, 3):
        monkeypatch.setattr(J, "ROUNDS", rounds)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(docs).collect()) == want


def test_copies_and_texts_without_words_in_many_blocks(spark, monkeypatch):
    from srcweave.llm import blocks
    from srcweave.llm.jaccard_join import jaccard_components, jaccard_dedup

    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda d, i, t, keep=(): pack(d, i, t, keep, block_bytes=200))
    rows = [(k, "one and the same text in every row") for k in range(40)] + [(100 + k, None if k % 2 else " ") for k in range(20)] + [(50, "another text of six words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == sorted([(k, 4, 0) for k in range(40)] + [(100 + k, 0, 100 + k) for k in range(20)] + [(50, 2, 50)])
    assert sorted(r.doc_id for r in jaccard_dedup(docs).collect()) == [0, 50, *range(100, 120)]

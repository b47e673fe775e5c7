"""Packing: exact round trips."""

import collections
import zlib

import numpy as np
import pytest


def _plain_ids(texts):
    from srcweave.llm.packing import tokenizer_path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def _check(pieces, ids_of):
    """Every id lies in one piece, every sequence is gapless; returns the tokens of each sequence."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[str(p.doc_id)].append((p.start, p.ids))
        by_seq[p.sequence_id].append((p.offset, p.length))
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, np.uint32).tobytes())
    got = collections.Counter(x for i, v in by_doc.items() for start, ids in v for x in ((i, start + k, t) for k, t in enumerate(ids)))
    assert got == collections.Counter((i, k, t) for i, ids in ids_of for k, t in enumerate(ids))
    full = []
    for s in range(len(by_seq)):
        at = 0
        for offset, n in sorted(by_seq[s]):
            assert offset == at
            at += n
        full.append(at)
    return full


def test_packing_round_trip(docs, rows, empty, spark, sf_dir):
    from srcweave.llm.packing import pack_sequences

    pieces = pack_sequences(docs).collect()
    ids = list(zip([str(i) for i, _ in rows], _plain_ids([t for _, t in rows]), strict=True))
    full = _check(pieces, ids)
    assert max(full) <= 2048 and len(full) * 2048 - sum(full) < 2048 and max(full) - min(full) <= 1
    assert all(p.doc_tokens == n for p in pieces for n in [p.doc_tokens])
    assert pack_sequences(empty).count() == 0


def test_added_tokens_are_those_of_the_plain_call():
    import pyarrow as pa
    from srcweave.llm.packing import Encoder, tokenizer_path
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|> world", "", "a b", "x<|startoftext|>y <|EndOfText|>", "<|endoftext|>", "end <|endoftext|", "<| endoftext |>", "é <|endoftext|><|endoftext|>\n z"]
    plain = Tokenizer.from_file(tokenizer_path())
    ids, n = Encoder(tokenizer_path()).encode(pa.array(texts))
    want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert want[0] == [3306, 49407, 1002, 1]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_windows_hold_the_proportions(spark, sf_dir):
    from srcweave.llm.packing import pack_sequences

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    pieces = pack_sequences(docs, with_ids=False).collect()
    total, each = collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        total[source[p.doc_id]] += p.length
        each[p.sequence_id][source[p.doc_id]] += p.length
    for s, c in each.items():
        for q, n in total.items():
            assert abs(c[q] - n * sum(c.values()) / sum(total.values())) <= len(total) + 1, (s, q)


def test_target_mixture_and_dry_queues(spark):
    from srcweave.llm.packing import pack_sequences

    docs = spark.createDataFrame([(i, "word " * 50, "abc"[i % 3] if i % 5 else None) for i in range(120)], "doc_id long, text string, source string")
    ids = [(str(r.doc_id), _plain_ids([r.text])[0]) for r in docs.collect()]
    pieces = pack_sequences(docs, mixture={"a": 0.7, "b": 0.2}, length=64).collect()
    full = _check(pieces, ids)
    assert max(full) <= 64
    first = collections.Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for p in pieces:
        if p.sequence_id < 5:
            first[source[p.doc_id]] += p.length
    assert abs(first["a"] / sum(first.values()) - 0.7) < 0.05


def test_each_of_many_sources_has_its_queue(spark):
    from srcweave.llm.packing import pack_sequences

    rows = [(i, "word " * (5 + i % 7), f"s{i % 90:02}") for i in range(1800)]
    rows.sort(key=lambda x: x[2])  # in partition order a pooled queue would give one source after another
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = [(str(i), x) for (i, _, _), x in zip(rows, _plain_ids([t for _, t, _ in rows]), strict=True)]
    source, size = {i: s for i, _, s in rows}, {i: len(x) for i, x in ids}
    total = collections.Counter()
    for i, _, s in rows:
        total[s] += size[str(i)]
    for mixture in (None, {"s89": 0.3, "s07": 0.1}):
        pieces = pack_sequences(docs, mixture=mixture, length=512).collect()
        _check(pieces, ids)
        each = collections.defaultdict(collections.Counter)
        for p in pieces:
            each[p.sequence_id][source[p.doc_id]] += p.length
        if mixture:
            assert all(abs(each[0][s] / sum(each[0].values()) - x) < 0.05 for s, x in mixture.items())
        for c in each.values():
            assert mixture or all(abs(c[s] - n * sum(c.values()) / sum(total.values())) <= 4 for s, n in total.items())


def test_tree_splits_every_token_once():
    from srcweave.llm.packing import Tree

    for totals in ([3], [5, 0, 2], [1] * 37 + [400, 9]):
        tree = Tree(totals)
        n = np.arange(tree.total + 1)
        given = np.array([tree.given(np.full(len(n), k), n) for k in range(len(totals))])
        assert (given[:, -1] == totals).all() and (np.diff(given, axis=1) >= 0).all() and (given.sum(axis=0) == n).all()
        for k in range(len(totals)):
            assert (tree.before(np.full(len(n), k), n * 0, n) == given[:k].sum(axis=0)).all()
    tree = Tree([7_000_000_001, 5_000_000_003, 1])
    n = np.array([0, 1, 9_876_543_210, tree.total])
    assert tree.given(np.zeros(4, np.int64), n).tolist() == [int(x) * 12_000_000_004 // 12_000_000_005 * 7_000_000_001 // 12_000_000_004 for x in n]


@pytest.mark.parametrize("totals", [[5], [1, 1], [10_000, 3, 0, 777], [2047, 1], [70, 60, 50, 40, 30, 20, 10, 9, 8, 7]])
def test_closed_form_deficits(totals):
    from srcweave.llm.packing import phases

    (p,) = phases(totals, None, 64)
    w = np.arange(p.windows + 1)
    given = np.array([p.given(q, w) for q in range(len(totals))])
    assert (given[:, -1] == totals).all() and (np.diff(given, axis=1) >= 0).all()
    assert np.diff(given.sum(axis=0)).max() <= 64
    for q, t in enumerate(totals):
        if t:
            at = p.window(q, np.arange(t))
            assert (given[q][at] <= np.arange(t)).all() and (given[q][at + 1] > np.arange(t)).all()
    p.exact = True
    assert all((p.given(q, w) == given[q]).all() for q in range(len(totals)))

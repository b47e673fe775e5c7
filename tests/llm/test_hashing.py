"""Words and lines built so that sums of byte values times powers can't tell them apart."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest


def _pair(n=1024):
    """A Thue-Morse word and its complement."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def twins(spark):
    """Two documents that differ in one such word, each with a benchmark item of its own word."""
    a, b = _pair()
    rest = [f"w{k}" for k in range(34)]
    return spark.createDataFrame([(1, " ".join([a, *rest])), (2, " ".join([b, *rest]))], "doc_id long, text string")


def test_hashes_differ_for_both_seeds():
    from srcweave.llm.textkit import SPACED, words

    for n in (16, 64, 1024, 4096):
        w = words(pa.array([" ".join(_pair(n)), "aaaaaaaabbbbbbbb bbbbbbbbaaaaaaaa", "ab ab\0 ab\0\0"]), SPACED)
        assert len(set(w.hashes().tolist())) == len(w) == len(set(w.hashes(1).tolist()))
        assert not set(w.hashes().tolist()) & set(w.hashes(1).tolist())


def test_a_word_hashes_alike_wherever_it_stands():
    from srcweave.llm import textkit

    texts = ["x" * k + " " + "é" * (k % 5) + " y" for k in range(300)]
    w = textkit.words(pa.array(texts), textkit.SPACED)
    raw = w.buf.tobytes()
    by_word = {}
    for s, e, h in zip(w.starts.tolist(), w.ends.tolist(), w.hashes().tolist(), strict=True):
        assert by_word.setdefault(raw[s:e], h) == h
    assert len(set(by_word.values())) == len(by_word)
    one = {k: textkit.words(pa.array([k.decode()]), textkit.SPACED).hashes()[0] for k in by_word}
    assert one == by_word


def test_substring_dedup_keeps_both(twins):
    from srcweave.llm.substring_dedup import substring_dedup

    assert [r.n_removed for r in substring_dedup(twins).collect()] == [0, 0]


def test_line_dedup_keeps_both(spark):
    from srcweave.llm.line_dedup import line_dedup

    a, b = _pair()
    docs = spark.createDataFrame([(1, a + "\nsame"), (2, b + "\nsame")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup(docs).collect()] == [0, 0]


def test_packing_gives_each_word_its_ids(spark):
    from srcweave.llm.packing import pack_sequences, tokenizer_path
    from tokenizers import Tokenizer

    a, b = _pair()
    docs = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x")], "doc_id long, text string").selectExpr("*", "'s' as source").coalesce(1)
    t = Tokenizer.from_file(tokenizer_path())
    want = {i: zlib.crc32(np.array([*t.encode(f"{x} x", add_special_tokens=False).ids, 1], np.uint32).tobytes()) for i, x in ((1, a), (2, b))}
    assert {r.doc_id: r.ids_crc32 for r in pack_sequences(docs).collect()} == want


def test_encoder_compares_words_even_where_hashes_agree(monkeypatch):
    from srcweave.llm import packing
    from tokenizers import Tokenizer

    whole = packing.Words.hashes
    monkeypatch.setattr(packing.Words, "hashes", lambda self, seed=0: whole(self, seed) % np.uint64(7))
    texts = ["one two three four five six seven eight nine ten", "", "two one", "a-b c'd 12 <|endoftext|> é", "supercalifragilistic expialidocious"]
    t = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path())
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_jaccard_join_links_neither(twins, spark):
    from srcweave.llm.jaccard_join import jaccard_components

    a, b = _pair()
    docs = spark.createDataFrame([(1, f"{a} b c d e"), (2, f"{b} b c d e")], "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard_components(docs).collect()) == [1, 2]


def test_decontamination_finds_its_own_item_only(twins, spark):
    from srcweave.llm.decontamination import decontaminate

    a, b = _pair()
    items = spark.createDataFrame([("A", a + " w0 w1 w2 w3 w4 w5 w6 w7 w8"), ("B", b + " w0 w1 w2 w3 w4 w5 w6 w7 w8")], "item_id string, text string")
    got = {r.doc_id: r["items"] for r in decontaminate(twins, items).collect()}
    assert got == {1: ["A"], 2: ["B"]} and re.match("[ab]", a)

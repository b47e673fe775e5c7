"""Columns whose names the operators use themselves, null item ids, long phrases, and texts beyond a chunk or a block."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "one two three", 7, "own", "L"), (2, "released under the mit license", 8, "mine", "M"), (3, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _weights int, rules string, license string")


def test_quality_rules_keep_columns_of_the_same_names(small, spark):
    from srcweave.llm.quality_rules import quality_rules

    got = quality_rules(small, spark.createDataFrame([(1,)], "doc_id long"))
    assert got.columns == ["doc_id", "text", "_weights", "rules_", "license", "rules"]
    assert {(r.doc_id, r._weights, r.rules_, r.license) for r in got.collect()} == {(1, 7, "own", "L"), (2, 8, "mine", "M"), (3, None, None, None)}
    both = quality_rules(small.withColumn("rules_", F.lit(1)), spark.createDataFrame([(1,)], "doc_id long"))
    assert both.columns == ["doc_id", "text", "_weights", "rules__", "license", "rules_", "rules"]
    named = small.drop("rules").withColumnRenamed("text", "Rules")
    assert quality_rules(named, spark.createDataFrame([(1,)], "doc_id long"), text_col="Rules").select("rules.n_words").count() == 3


def test_license_scan_keeps_a_license_column(small):
    from srcweave.llm.license_scan import license_scan

    got = license_scan(small)
    assert got.columns == ["doc_id", "text", "_weights", "rules", "license_", "license"]
    assert {(r.doc_id, r.license_, tuple(r.license.labels)) for r in got.collect()} == {(1, "L", ()), (2, "M", ("mit",)), (3, None, ())}


def test_license_phrases_and_templates_of_any_length(spark):
    from srcweave.llm.license_scan import license_scan

    docs = spark.createDataFrame([(1, "x Zlib y"), (2, "a b c d e f g h"), (3, "a b c d e f g"), (4, "one two three four five\nsix seven")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan(docs, phrases={"zlib": "z", "a b c d e f g h": "long"}, texts=(("t", "two three four five six seven"),)).collect()}
    assert [(got[k].n_base, got[k].base_labels, got[k].labels) for k in (1, 2, 3, 4)] == [(1, ["z"], ["z"]), (1, ["long"], ["long"]), (0, [], []), (0, [], ["t"])]


def test_items_without_an_id_hit_and_count_once(spark):
    from srcweave.llm.decontamination import decontaminate

    docs = spark.createDataFrame([(1, "p q r s t u v w x y z"), (2, "k l m")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "p q r s t u v w x y"), (None, "q r s t u v w x y z"), ("I", "k l"), (None, None)], "item_id string, text string")
    got = {r.doc_id: (list(r.hits), list(r["items"])) for r in decontaminate(docs, items).collect()}
    assert got == {1: (list(range(11)), [None]), 2: ([0, 1], ["I"])}


def test_items_longer_than_a_block_keep_their_windows(spark, monkeypatch):
    from srcweave.llm import decontamination as D

    monkeypatch.setattr(D, "BLOCK_WORDS", 25)
    item = " ".join(f"W{k}" for k in range(120))
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 10))) for k in range(111)] + [(500, "w1 w3 w2")], "doc_id long, text string")
    got = {r.doc_id: (len(r.hits), list(r["items"])) for r in D.decontaminate(docs, spark.createDataFrame([("A", item)], "item_id string, text string")).collect()}
    assert got == {k: (10, ["A"]) for k in range(111)} | {500: (0, [])}


def test_texts_beyond_a_chunk_and_a_block(spark):
    """One text of 10 MB beside small ones, through every operator on blocks and chunks; each is compared with plain Python."""
    from srcweave.llm.jaccard_join import jaccard_components
    from srcweave.llm.line_dedup import line_dedup
    from srcweave.llm.packing import pack_sequences
    from srcweave.llm.pii import find_pii
    from srcweave.llm.substring_dedup import substring_dedup

    many = " ".join(f"word{k}" for k in range(1_000_000))
    tail = " ".join(f"word{k}" for k in range(999_900, 1_000_000))
    docs = spark.createDataFrame([(1, many), (2, "a@b.cd " + tail), (3, "x\ny"), (4, "q\nx\ny"), (5, many)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert len(many) > 9 << 20
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == {1: (1_000_000, 1_000_000), 2: (101, 100), 3: (2, 0), 4: (3, 0), 5: (1_000_000, 1_000_000)}
    assert {r.doc_id: r.n_removed for r in line_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 1}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == {1: (999_996, 1), 2: (97, 2), 3: (1, 3), 4: (1, 4), 5: (999_996, 1)}
    assert {r.doc_id: len(r.spans) for r in find_pii(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    pieces = pack_sequences(docs.where("doc_id > 1"), with_ids=False).collect()
    n = {r.doc_id: 0 for r in pieces}
    for p in pieces:
        n[p.doc_id] += p.length
    assert n == {p.doc_id: p.doc_tokens for p in pieces} and n[5] > 1_000_000


def test_mixture_by_temperature(spark):
    from srcweave.llm.packing import pack_sequences

    rows = [(i, "word " * 40, "big" if i % 10 else "small") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    pieces = pack_sequences(docs, mixture=0.5, length=256, with_ids=False).collect()
    last = max(p.sequence_id for p in pieces)
    first = {"big": 0, "small": 0}
    for p in pieces:
        if p.sequence_id < last // 4:
            first[source[p.doc_id]] += p.length
    want = 9**0.5 / (9**0.5 + 1)
    assert abs(first["big"] / sum(first.values()) - want) < 0.02
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)

"""Operators whose state or reads are bounded, against plain versions on small or odd inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from srcweave.operators import impact, paths as P
from srcweave.operators.impact import BYTES, _merged, _ored, caller_counts, caller_estimates
from srcweave.operators.numbering import numbered
from srcweave.operators.resolve import taint_matches
from srcweave.operators.sections import section_spans
from srcweave.operators.textindex import PageIndex, TextIndex, TrigramIndex
from srcweave.operators.upsert import renders
from srcweave.plans import roster, scratch
from srcweave.plans.testgraph import Tables


def _edges(seed, n=25, m=70):
    dice = random.Random(seed)
    return [(f"f{dice.randrange(n)}", f"f{dice.randrange(n)}", dice.random() < 0.2, dice.random() < 0.2) for _ in range(m)]


def _callers(edges, depth):
    direct, every = {}, {}
    for d in {b for _, b, *_ in edges}:
        level, seen = {d}, set()
        for k in range(depth):
            level = {a for a, b, *_ in edges if b in level}
            seen |= level
            if k == 0:
                direct[d] = len(level - {d})
        every[d] = len(seen - {d})
    return {d: (direct[d], every[d] - direct[d]) for d in direct}


@pytest.mark.parametrize(("seed", "depth"), [(1, 1), (2, 2), (3, 3), (4, 5)])
def test_caller_counts(spark, seed, depth):
    edges = _edges(seed)
    df = spark.createDataFrame([*edges, ("x", None, False, False), edges[0]], "src string, dst string, t boolean, z boolean")
    assert {r.id: (r.direct, r.transitive) for r in caller_counts(df, depth).collect()} == _callers(edges, depth)


def test_caller_counts_over_several_bitmaps_and_passes(spark):
    n = 40_000  # more than one bitmap holds
    chain = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    got = caller_counts(chain, 3, buckets=1).selectExpr("id", "direct", "transitive")
    want = chain.selectExpr("dst as id", "1L as direct", "least(dst - 1, 2) as transitive")
    assert got.exceptAll(want).isEmpty() and got.count() == n - 1
    assert caller_counts(chain.where("false")).collect() == []


def test_callers_by_lists(spark):
    """Functions in several batches, callers in several blocks, a hub that calls many and is called by many."""
    edges = _far_edges(3, 200)
    hops = spark.createDataFrame(edges, "s long, d long").repartition(3)
    n = len({x for e in edges for x in e})
    within, count, _ = impact._within(hops.select(F.explode(F.array("s", "d")).alias("k")).distinct(), hops, 3)
    assert count == n
    got = impact._by_lists(hops, within, n, 3, listed=100).collect()
    assert len(got) == len({b for _, b in edges})
    assert {r.d: (r.direct, r.every - r.direct) for r in got} == _callers(edges, 3)


def _far_edges(seed, hub):
    dice = random.Random(seed)
    far = lambda: dice.choice((1, 20_000, 60_000)) + dice.randrange(120)
    return sorted({(far(), far()) for _ in range(500)} | {(1, far()) for _ in range(hub)} | {(far(), 1) for _ in range(hub)} | {(7, 7), (8, 9), (9, 8)})


@pytest.mark.parametrize(("depth", "walks", "roots"), [(1, 9, 1), (2, 9, 1), (3, 50, 1), (3, 1 << 22, 40), (4, 1 << 22, 1)])
def test_walks_of_a_batch_are_cut_at_whole_callers(monkeypatch, depth, walks, roots):
    import numpy as np

    monkeypatch.setattr(impact, "WALKS", walks)
    edges = _far_edges(depth, 200)
    s, d = np.array(edges).T
    own = d % roots == 0
    held = impact._Callers(s[own], d[own], depth)
    for hop in range(2, depth + 1):
        for block in np.unique(s >> 14):
            held.meet(hop, s[s >> 14 == block], d[s >> 14 == block])
    got = {r["d"]: (r["direct"], r["every"] - r["direct"]) for r in held.counts().to_pylist()}
    assert got == {k: v for k, v in _callers(edges, depth).items() if k % roots == 0}


def test_sketches_of_a_thin_graph_are_not_sent(spark, monkeypatch):
    """4 KB were sent for each function and block of callers; the lists give the same estimates."""
    edges = _far_edges(3, 100)
    begun = impact.known(spark.createDataFrame(edges, "src long, dst long"), 3)
    want = {r.d: r.callers for r in impact._by_sketches(begun[1], 3, 12).collect()}
    got = impact._by_lists(begun[1], begun[2], begun[3], 3, 2000, 12)
    assert {r.d: r.callers for r in got.collect()} == want and len(want) == len({b for _, b in edges})
    monkeypatch.setattr(impact, "_by_sketches", lambda *a: pytest.fail("sketches"))
    caller_estimates(spark.range(3000).selectExpr("id as src", "id + 1 as dst"))


def test_callers_of_all_hops_are_not_shuffled(spark, monkeypatch):
    """A thin graph goes by lists, and what the last hop finds is counted in its task: bitmaps of 4 KB for each function were sent."""
    monkeypatch.setattr(impact, "_by_bitmaps", lambda *a: pytest.fail("bitmaps"))
    calls = spark.range(3000).selectExpr("id as src", "explode(array((id * 7 + 1) % 3000, (id * 11 + 5) % 3000)) as dst")
    want = _callers([tuple(r) for r in calls.distinct().collect()], 3)
    assert {r.id: (r.direct, r.transitive) for r in caller_counts(calls).collect()} == want


def test_a_block_sends_a_bitmap_for_each_function_it_calls():
    """Not one for each call: 900 calls from 300 functions to 3, in two groups that are cut by batches."""
    import pyarrow as pa

    bit = lambda s: bytes([0] * (s // 8) + [1 << s % 8] + [0] * (BYTES - s // 8 - 1))
    rows = [{"bucket": b, "block": 0, "s": s, "d": d, "bits": None if d else bit(s)} for b in (1, 2) for s in range(300) for d in (None, 7001, 7002, 7003)]
    kind = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("s", pa.int64()), ("d", pa.int64()), ("bits", pa.binary())])
    whole = pa.RecordBatch.from_pylist(rows, kind)
    got = [r for b in _ored(whole.slice(k, 500) for k in range(0, len(rows), 500)) for r in b.to_pylist()]
    called = [r for r in got if r["d"] > 7000]
    assert sorted((r["bucket"], r["d"]) for r in called) == [(b, d) for b in (1, 2) for d in (7001, 7002, 7003)]
    assert {r["bits"] for r in called} == {bytes([255] * 37 + [15] + [0] * (BYTES - 38))} and len(got) == 606
    assert list(_ored([])) == []


def test_a_block_sends_a_sketch_for_each_function_it_calls():
    import numpy as np
    import pyarrow as pa

    kind = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("s", pa.int64()), ("d", pa.int64()), ("bits", pa.binary())])
    rows = [{"bucket": 0, "block": 0, "s": s, "d": d, "bits": None if d else bytes([s, 9 - s])} for s in range(10) for d in (None, 7001, 7002)]
    got = [r for b in _merged([pa.RecordBatch.from_pylist(rows, kind)], np.maximum, np.uint8) for r in b.to_pylist() if r["d"] > 7000]
    assert [(r["d"], r["bits"]) for r in got] == [(7001, bytes([9, 9])), (7002, bytes([9, 9]))]


@pytest.mark.parametrize("n", [1, 7, 300, 4000, 12_000, 70_000])
def test_caller_estimates_at_any_count(spark, n):
    got = caller_estimates(spark.range(n).selectExpr("id as src", "-1L as dst"), 1).collect()
    assert [r.id for r in got] == [-1] and abs(got[0].callers - n) <= 0.05 * n + 0.5
    assert caller_estimates(spark.range(0).selectExpr("id as src", "-1L as dst")).collect() == []


def test_caller_estimates(spark):
    star = spark.range(20_000).selectExpr("id as src", "if(id < 10000, -1L, -2L) as dst").unionAll(spark.createDataFrame([(-1, -2)], "src long, dst long"))
    got = {r.id: r.callers for r in caller_estimates(star, 2).collect()}
    assert abs(got[-1] - 10_000) < 500 and abs(got[-2] - 20_001) < 1000


@pytest.mark.parametrize("seed", [5, 6])
def test_flag_search(spark, seed):
    edges = _edges(seed, 12, 26)
    df = spark.createDataFrame(edges, "src string, dst string, t boolean, z boolean")
    found = scratch.materialize(P.flag_search(df, spark.createDataFrame([("f0",), ("f1",)], "id string"), ("t", "z")), "search")
    want = {}
    for root in ("f0", "f1"):
        level, depth = {(root, 0)}, 0
        while level:
            for x in level:
                want.setdefault((root, *x), depth)
            level = {(b, m | t | z * 2) for a, b, t, z in edges for v, m in level if v == a}
            level = {x for x in level if (root, *x) not in want}
            depth += 1
    assert {(r.root, r.id, r["mask"]): r.depth for r in found.collect()} == want
    for r in P.witnesses(found, found.where("depth > 0").select("root", "id", "mask")).collect():
        masks = {0}
        for a, b in itertools.pairwise(r.nodes):
            masks = {m | t | z * 2 for x, y, t, z in edges if (x, y) == (a, b) for m in masks}
        assert r["mask"] in masks and r.nodes[0] == r.root and r.nodes[-1] == r.id and len(r.nodes) - 1 == want[r.root, r.id, r["mask"]]


def test_flag_search_sends_a_row_for_an_edge_and_level(spark):
    """Not one for each root and set of flags; more roots than a number has room for."""
    edges = _edges(9, 30, 60)
    df = spark.createDataFrame(edges, "src string, dst string, t boolean, z boolean")
    starts = spark.createDataFrame([(f"f{k}",) for k in range(20)], "id string")
    whole = P.flag_search(df, starts, ("t", "z"))
    ends = {(r.root, r.id, r["mask"]): r.depth for r in P.flag_search(df, starts, ("t", "z"), before=False).collect()}
    assert ends == {(r.root, r.id, r["mask"]): r.depth for r in whole.collect()}
    for k in (0, 7, 19):
        alone = P.flag_search(df, starts.where(f"id = 'f{k}'"), ("t", "z"), before=False)
        assert {(r.root, r.id, r["mask"]): r.depth for r in alone.collect()} == {x: d for x, d in ends.items() if x[0] == f"f{k}"}
    cell = spark.createDataFrame([(3, 0b0001_0011)], "_m int, bits long")
    assert cell.select(P._meet(F.col("bits"), 4, 2)).first()[0] == 0b1000_1000
    assert cell.select(P._meet(F.shiftleft(F.col("bits"), 63), 4, 2)).first()[0] == -(1 << 63)


@pytest.mark.parametrize("limit", [1, 7, 40, 10_000])
def test_first_trails(spark, limit):
    edges = [(a, b) for a, b, *_ in _edges(8, 7, 11)]
    df = spark.createDataFrame(sorted(set(edges)), "src string, dst string")
    start = spark.createDataFrame([("f0",), ("f3",)], "id string")
    got = [(r.length, r.nodes) for r in P.first_trails(df, start, limit).collect()]
    every = [(r.length, r.nodes) for r in P.trails(df, start, 12).collect()]
    assert sorted(got) == sorted(every)[:limit]


def test_numbered(spark):
    got = [(r.id, r.number) for r in numbered(spark.range(1000).selectExpr("(id * 37) % 1000 as id"), "id").collect()]
    assert sorted(got) == [(k, k) for k in range(1000)]


def test_text_index(spark, tmp_path):
    import math

    docs = [(1, "A red fox. The red one"), (2, "the fox"), (3, ""), (4, None), (5, "Red-red RED, blue"), (None, "red red")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i"))
    assert index.search("red").collect() == []
    index.add(df.where("doc_id <= 2 or doc_id is null"))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    index.add(df.where("doc_id > 2"))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    assert before.items() <= after.items()  # what was there is untouched
    words = {1: ["a", "red", "fox", "the", "red", "one"], 2: ["the", "fox"], 3: [], 4: [], 5: ["red", "red", "red", "blue"]}
    want, mean = {}, sum(map(len, words.values())) / 5
    for q in ("red", "fox"):
        n = sum(q in w for w in words.values())
        for i, w in words.items():
            if q in w:
                tf = w.count(q)
                want[i] = want.get(i, 0) + math.log(1 + (5 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    check = lambda: {r.id: pytest.approx(r.score, abs=1e-9) for r in index.search("Fox! red red").collect()}
    assert check() == want
    index.merge()
    assert len(index.segments()) == 1 and check() == want
    assert [r.id for r in index.search("red fox", 1).collect()] == [max(want, key=want.get)]


def _files_read(df):
    node = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply("numFiles").value()


def test_trigram_index(spark, tmp_path):
    names = ["makePerson", "person", "PERSONal", "per son", "ab", None, "écoleÉCOLE", "%_x%_", "aaa", "aaaa"]
    rows = spark.createDataFrame([(f"n{k}", x, f"/src/{x}.ts") for k, x in enumerate(names)] + [(None, "person", "")], "id string, name string, path string")
    index = TrigramIndex.build(rows, ("name", "path"), str(tmp_path / "i"))
    for term in ("person", "PER", "ab", "a", "aaa", "école", "%_x", "src/p", "nothing here"):
        got = sorted(r.id for r in index.search(term, ("name", "path")).collect())
        assert got == [f"n{k}" for k, x in enumerate(names) if term.lower() in (x or "").lower() or x is not None and term.lower() in f"/src/{x}.ts".lower()], term
    assert sorted(r.id for r in index.search("PERSON", ("name",), case=True).collect()) == ["n2"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        every = len(list((tmp_path / "i" / "lists").rglob("*.parquet")))
        assert 0 < _files_read(index.lists("per")) <= 2 < every
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_page_index(spark, tmp_path):
    nodes = spark.range(2500).selectExpr("concat('n', id) as id", "if(id % 3 = 0, 'File', 'Function') as label", "concat('name', (id * 7) % 2500) as name", "if(id % 3 = 0, concat('/p', id), null) as path")
    want = sorted((r.path if r.label == "File" else r.name, r.id) for r in nodes.collect())
    index = PageIndex.build(nodes, str(tmp_path / "i"), size=300)
    for page, limit in ((1, 100), (4, 90), (25, 100), (26, 100)):
        rows = index.page(page, limit)
        assert [r.id for r in rows.collect()] == [i for _, i in want[(page - 1) * limit : page * limit]]
        assert len({r.number // 300 for r in rows.collect()}) <= 2
    by = PageIndex.build(nodes, str(tmp_path / "j"), by="label", size=300)
    files = [i for k, i in want if k.startswith("/p")]
    assert [r.id for r in by.page(9, 100, "File").collect()] == files[800:900] and by.page(1, 10, "Class").collect() == []


@pytest.mark.parametrize("part", [1, 3, 10_000])
def test_section_spans(spark, part):
    dice = random.Random(part)
    docs = [(d, n * 5 + 3) for d, n in enumerate((0, 1, 2, 9, 40))]
    rows = [(d, line * 5, dice.randint(1, 6), f"{d}-{line}") for d, lines in docs for line in range(1, lines // 5 + 1)]
    got = section_spans(spark.createDataFrame(rows, "file_path int, start_line int, level int, id string"), spark.createDataFrame(docs, "file_path int, lines int"), part)
    for r in got.collect():
        own = [x for x in rows if x[0] == r.file_path]
        after = [line for _, line, level, _ in own if line > r.start_line and level <= r.level]
        above = [(line, i) for _, line, level, i in own if line < r.start_line and level < r.level]
        assert (r.end_line, r.parent_id) == (min(after) - 1 if after else dict(docs)[r.file_path], max(above)[1] if above else None)
    assert got.count() == len(rows)


def test_taint_matches(spark):
    dice = random.Random(2)
    word = lambda n: "".join(dice.choice("ab%_") for _ in range(n))
    sources = [(dice.randrange(3), word(dice.randint(0, 6)), k) for k in range(60)] + [(0, None, 99)]
    sinks = [(dice.randrange(3), word(dice.randint(0, 12)) + dice.choice(["", "clean"]), k) for k in range(60)] + [(0, None, 99)]
    got = taint_matches(spark.createDataFrame(sources, "file int, variable string, source int"), spark.createDataFrame(sinks, "file int, argument string, sink int"), ("clean",))
    want = sorted((a, b) for f, v, a in sources for g, x, b in sinks if f == g and v is not None and x is not None and v in x and "clean" not in x)
    assert sorted((r.source, r.sink) for r in got.collect()) == want
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()


def test_taint_matches_in_a_hot_file(spark):
    """Ten to the five of each in one file: pairs that are tested follow the result."""
    n = 100_000
    sources = spark.range(n).selectExpr("1 as file", "concat(lpad(conv(id, 10, 36), 4, '0'), 'x') as variable", "id as source")
    sinks = spark.range(n).selectExpr("1 as file", "concat('f(', lpad(conv(id, 10, 36), 4, '0'), 'x)') as argument", "id as sink")
    got = taint_matches(sources, sinks)
    assert got.where("source <> sink").limit(1).count() == 0 and got.count() == n


def test_queries_run_after_clean(spark, sf_dir):
    found = roster.load()[0]
    before = found["most_connected"](spark, sf_dir).collect()
    pages = found["page_first"](spark, sf_dir).collect()
    assert scratch.clean(spark) > 0
    assert found["most_connected"](spark, sf_dir).collect() == before and found["page_first"](spark, sf_dir).collect() == pages


def test_a_packed_table_is_not_broadcast(spark, sf_dir):
    """Ids in order pack twenty times and more: files of 2 MB hold far more than a broadcast may have."""
    Tables(spark, sf_dir)
    packed = scratch.materialize(spark.range(400_000).selectExpr("id as k", "concat('Function:/AFRICA/KENYA/Supplier#000000001.ts:', id) as id"), "packed")
    joined = packed.join(packed.withColumnRenamed("k", "j"), "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    small = scratch.materialize(spark.range(10).selectExpr("concat('Function:', id) as id"), "small")
    assert "BroadcastHashJoin" in packed.join(small, "id")._jdf.queryExecution().sparkPlan().toString()


def test_tables_by_label(spark):
    pieces = {"CALLS": spark.range(3).selectExpr("id", "id * 2 as n"), "a=b/c": spark.range(2).selectExpr("id * 5 as n", "id"), "NONE": spark.range(0).selectExpr("id", "id as n")}
    got = scratch.by_label(pieces, "pieces")
    assert sorted(map(tuple, got.select("label", "id", "n").collect())) == [("CALLS", 0, 0), ("CALLS", 1, 2), ("CALLS", 2, 4), ("a=b/c", 0, 0), ("a=b/c", 1, 5)]
    assert "PartitionFilters: [isnotnull(label" in got.where("label = 'CALLS'")._jdf.queryExecution().executedPlan().toString()


def test_renders_does_not_shuffle_its_pairs(spark):
    refs = spark.createDataFrame([("a", "x", 3), ("a", "x", 2), ("b", "x", 1), ("b", "y", None), ("c", None, 1)], "src string, child string, line int")
    known = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "x"), ("3", "z"), ("4", None)], "id string, name string")
    got = renders(refs, known)
    assert sorted(map(tuple, got.collect())) == [("a", "1", 2), ("a", "2", 2), ("b", "1", 1), ("b", "2", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan.splitlines()[1] and "Aggregate" not in plan.splitlines()[0]


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_relation_groups_shuffles_rows_once(spark):
    from srcweave.operators.analysis import relation_groups

    rows = [("a", "out", "CALLS", f"x{k:02}") for k in range(40)] * 2 + [("b", "in", "READS", "y"), ("b", "in", "READS", "y"), ("b", "in", "CALLS", None)]
    df = spark.createDataFrame(rows, "id string, direction string, type string, other string")
    got = relation_groups(df)
    assert sorted(map(tuple, got.collect())) == [("a", "CALLS", "out", 40, "x00,x01,x02,x03,x04"), ("b", "CALLS", "in", 1, ""), ("b", "READS", "in", 1, "y")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_in_their_row(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    seen = []
    index._write = lambda postings, *rest: seen.append(postings)
    index.add(spark.createDataFrame([(1, "b a b, b c a"), (2, ""), (3, "d")], "doc_id long, text string"))
    assert sorted(map(tuple, seen[0].select("word", "id", "size", "tf").collect())) == [("a", 1, 6, 2), ("b", 1, 6, 3), ("c", 1, 6, 1), ("d", 3, 1, 1)]
    assert _shuffles(seen[0]) == 0


def test_components_are_found_over_numbers(spark, sf_dir, monkeypatch):
    from srcweave.plans import queries_paths

    kinds, real = [], queries_paths.connected_components
    monkeypatch.setattr(queries_paths, "connected_components", lambda e, *ends: kinds.extend(e.schema[c].dataType.simpleString() for c in ends) or real(e, *ends))
    roster.load()[0]["components"](spark, sf_dir)
    assert kinds == ["bigint", "bigint"]


def test_levels_of_a_chain_do_not_sort_the_orders_again(spark, sf_dir):
    assert "Window" not in roster.load()[0]["order_chain_deep"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_a_change_are_not_shuffled(spark):
    from srcweave.operators.linkstore import ROW, LinkStore

    rows = spark.createDataFrame([("a", "x", "def", 1), ("b", "x", "ref", 2)], ROW)
    made = LinkStore._edges(rows, rows.where("false"))
    assert [tuple(r) for r in made.collect()] == [("b", "a", "x", 2)]
    assert "hashpartitioning(src" not in made._jdf.queryExecution().executedPlan().toString()


def test_tasks_read_bounded_parts(spark, sf_dir):
    Tables(spark, sf_dir)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("16m", "16777216b", "16777216")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "5m")
    Tables(spark, sf_dir)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("5m", "5242880b")  # the session's own stays
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_a_shuffle_has_more_parts_for_more_input(spark, sf_dir, tmp_path):
    """With a fixed number what one task sorts and groups grows as the input does."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with open(tmp_path / "lineitem.parquet", "wb") as f:
        f.truncate(41 << 20)
    Tables(spark, str(tmp_path))
    assert spark.conf.get(key) == "11" == str(scratch.parts(spark))
    plan = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and ", 11)" in plan
    assert [r.number for r in numbered(spark.range(1000).selectExpr("999 - id as id"), "id").orderBy("id").collect()] == list(range(1000))
    Tables(spark, sf_dir)
    assert spark.conf.get(key, None) is None and scratch.parts(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(key, "7")
    Tables(spark, str(tmp_path))
    assert spark.conf.get(key) == "7"  # the session's own stays
    spark.conf.unset(key)


def test_accesses_are_made_distinct_once(spark, sf_dir):
    plan = Tables(spark, sf_dir)._accesses("READS")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_dealt_rows_follow_the_input_too(spark):
    from srcweave.operators.analysis import relation_groups

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    refs = spark.createDataFrame([("a", "x", 3)], "src string, child string, line int")
    known = spark.createDataFrame([("1", "x")], "id string, name string")
    rows = spark.createDataFrame([("a", "out", "CALLS", "x")], "id string, direction string, type string, other string")
    spark.conf.set(key, "13")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (renders(refs, known), relation_groups(rows))]
    finally:
        spark.conf.unset(key)
    assert all(", 13), REPARTITION_BY_NUM" in p for p in plans)

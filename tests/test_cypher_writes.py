"""Writing clauses on a small graph, row by row."""

import pytest

from srcweave.operators.graph import PropertyGraph
from srcweave.plans.cypher import CypherError
from srcweave.plans.cypher_writes import changes

NODES = [("File:/a.ts", "File", "a.ts", "/a.ts", None, None), ("Function:/a.ts:f:1", "Function", "f", None, "/a.ts", 1), ("Function:/a.ts:g:9", "Function", "g", None, "/a.ts", 9), ("Function:/a.ts:h:20", "Function", "h", None, "/a.ts", 20)]
EDGES = [("File:/a.ts", n[0], "CONTAINS", None, None) for n in NODES[1:]] + [(NODES[1][0], NODES[2][0], "CALLS", 2, 1), (NODES[2][0], NODES[3][0], "CALLS", 10, 3)]


@pytest.fixture(scope="module")
def graph(spark):
    return PropertyGraph(spark.createDataFrame(NODES, "id string, label string, name string, path string, file_path string, start_line long"), spark.createDataFrame(EDGES, "src string, dst string, label string, line int, count long"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_set(graph):
    new = changes(graph, "MATCH (a:Function)-[c:CALLS]->(b:Function) SET a.startLine = b.startLine, c.count = c.count + $n, a.name = toUpper(a.name)", {"n": 10}).apply(graph)
    assert {r["name"]: r.start_line for r in new.nodes.where("label = 'Function'").collect()} == {"F": 9, "G": 20, "h": 20}  # reads come before writes
    assert sorted(r["count"] for r in new.edges.where("label = 'CALLS'").collect()) == [11, 13] and new.edges.count() == len(EDGES)


def test_merge_edge_creates_once_and_matches(graph):
    text = "MATCH (a:Function)-[:CALLS]->(b:Function) MERGE (b)-[r:CALLS]->(a) ON CREATE SET r.count = 1, r.line = a.startLine ON MATCH SET r.count = 99"
    got = changes(graph, text)
    assert _rows(got.edges.select("src", "dst", "line", "count")) == sorted([(NODES[2][0], NODES[1][0], 1, 1), (NODES[3][0], NODES[2][0], 9, 1)], key=str)
    once = got.apply(graph)
    assert _rows(got.apply(once).edges) == _rows(once.edges) and _rows(got.apply(once).nodes) == _rows(graph.nodes)
    again = changes(once, text).apply(once)
    assert sorted(r["count"] for r in again.edges.where("label = 'CALLS'").collect()) == [99, 99, 99, 99]  # each pair has both directions by now


def test_merge_node(graph):
    got = changes(graph, "MERGE (n:Class {name: 'K', filePath: '/k.ts', startLine: 4}) ON CREATE SET n.path = 'new' ON MATCH SET n.path = 'old'")
    assert _rows(got.nodes.select("id", "label", "name", "path")) == [("Class:/k.ts:K:4", "Class", "K", "new")]
    once = got.apply(graph)
    again = changes(once, "MERGE (n:Class {name: 'K', filePath: '/k.ts', startLine: 4}) ON CREATE SET n.path = 'new' ON MATCH SET n.path = 'old'").apply(once)
    assert [r.path for r in again.nodes.where("label = 'Class'").collect()] == ["old"] and again.nodes.count() == len(NODES) + 1


def test_deletes(graph):
    new = changes(graph, "MATCH (a:Function {name: 'g'}) DETACH DELETE a").apply(graph)
    assert new.nodes.count() == 3 and {r.label for r in new.edges.collect()} == {"CONTAINS"}
    new = changes(graph, "MATCH (:Function)-[r:CALLS]->(b:Function) WHERE b.startLine > 9 DELETE r").apply(graph)
    assert new.edges.where("label = 'CALLS'").count() == 1 and new.nodes.count() == 4
    for text in ("MATCH (a:Function) DELETE a", "MATCH (a:Function) SET a.id = 'x'", "MATCH (a:Function) SET a.nothing = 1", "MATCH (a:Function) RETURN a"):
        with pytest.raises(CypherError):
            changes(graph, text)


def test_only_variables_that_writes_name_are_written(graph, monkeypatch):
    from srcweave.plans import scratch

    read, real = [], scratch.materialize
    monkeypatch.setattr(scratch, "materialize", lambda df, name, *more: (read.append(df.columns) if name == "read" else None) or real(df, name, *more))
    new = changes(graph, "MATCH (f:Function)-[:CALLS]->(g:Function) WHERE g.startLine < 20 SET f.startLine = f.startLine + 1").apply(graph)
    assert read == [["_one", "f"]] and {r["name"]: r.start_line for r in new.nodes.where("label = 'Function'").collect()} == {"f": 2, "g": 9, "h": 20}
    changes(graph, "MATCH (f:Function)-[r:CALLS]->(g:Function) DELETE r")
    changes(graph, "MATCH (f:Function) MERGE (c:Class {name: 'x', filePath: '/x'})")
    assert read[1:] == [["_one", "r"], ["_one"]]

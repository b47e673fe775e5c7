"""The query language against the operators and by hand."""

import pytest

from srcweave.operators.graph import PropertyGraph
from srcweave.plans.cypher import CypherError, cypher


@pytest.fixture(scope="module")
def graph(spark):
    n = [("f1", "File", "a.ts", "/a.ts", None, None, None), ("f2", "File", "b.ts", "/b.ts", None, None, None)]
    n += [(x, "Function", x, None, f"/{'ab'[k % 2]}.ts", k * 10, c) for k, (x, c) in enumerate([("p", 3), ("q", 30), ("r", None), ("s", 7)])]
    e = [("f1", "p", "CONTAINS", None), ("f2", "q", "CONTAINS", None), ("f1", "r", "CONTAINS", None), ("f2", "s", "CONTAINS", None)]
    e += [("p", "q", "CALLS", 1), ("q", "r", "CALLS", 2), ("r", "p", "CALLS", 3), ("s", "q", "CALLS", 4), ("s", "s", "CALLS", 5)]
    nodes = spark.createDataFrame(n, "id string, label string, name string, path string, file_path string, start_line int, complexity int").withColumn("is_external", __import__("pyspark").sql.functions.lit(False))
    edges = spark.createDataFrame(e, "src string, dst string, label string, line int").withColumn("tainted", __import__("pyspark").sql.functions.expr("line = 1"))
    return PropertyGraph(nodes, edges)


def rows(df):
    return [tuple(r) for r in df.collect()]


CASES = [
    ("MATCH (n:Function) WHERE n.complexity > 5 RETURN n.name AS name ORDER BY n.complexity DESC", {}, [("q",), ("s",)]),
    ("MATCH (n:Function) RETURN n.name ORDER BY n.complexity LIMIT 2", {}, [("p",), ("s",)]),
    ("MATCH (n:Function) RETURN n.name ORDER BY n.complexity DESC SKIP 1 LIMIT 1", {}, [("q",)]),
    ("MATCH (a:Function)-[:CALLS]->(b:Function {name: $x}) RETURN a.name AS a ORDER BY a", {"x": "q"}, [("p",), ("s",)]),
    ("MATCH (b)<-[:CALLS]-(a) WHERE b.name = 'q' RETURN count(a) AS n", {}, [(2,)]),
    ("MATCH (n:File)-[:CONTAINS]->(m) RETURN n.path AS f, count(m) AS n ORDER BY n DESC, f", {}, [("/a.ts", 2), ("/b.ts", 2)]),
    ("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n ORDER BY label", {}, [("File", 2), ("Function", 4)]),
    ("MATCH ()-[r]->() RETURN type(r) AS t, count(r) AS n ORDER BY t", {}, [("CALLS", 5), ("CONTAINS", 4)]),
    ("MATCH (a:Function {name: 'p'})-[r]-(b) RETURN b.name AS b ORDER BY b", {}, [("a.ts",), ("q",), ("r",)]),
    ("MATCH (s:Function {name: 's'})-[:CALLS]-(b) RETURN b.name AS b ORDER BY b", {}, [("q",), ("s",)]),
    ("MATCH (a:Function {name: 's'})-[:CALLS*1..3]->(b) RETURN DISTINCT b.name AS b ORDER BY b", {}, [("p",), ("q",), ("r",), ("s",)]),
    ("MATCH path = (a:Function {name: 'p'})-[:CALLS*1..3]->(b) RETURN b.name AS b, length(path) AS d ORDER BY d", {}, [("q", 1), ("r", 2), ("p", 3)]),
    ("MATCH path = (a {name: 'p'})-[:CALLS*1..3]->(b) WHERE any(x IN relationships(path) WHERE x.tainted) RETURN [y IN relationships(path) | y.line] AS l ORDER BY length(path)", {}, [([1],), ([1, 2],), ([1, 2, 3],)]),
    ("MATCH path = (a {name: 's'})-[:CALLS*1..2]->(b) WHERE none(x IN relationships(path) WHERE x.line = 5) RETURN nodes(path) AS n ORDER BY length(path)", {}, [(["s", "q"],), (["s", "q", "r"],)]),
    ("MATCH (f:File) OPTIONAL MATCH (f)-[:CONTAINS]->(n:Function) WHERE n.complexity >= 30 RETURN f.path AS f, count(n) AS n ORDER BY f", {}, [("/a.ts", 0), ("/b.ts", 1)]),
    ("MATCH (n:Function) WITH n.filePath AS f, avg(n.complexity) AS m WHERE m > 5 RETURN f, m", {}, [("/b.ts", 18.5)]),
    ("MATCH (n:Function) WHERE n.name IN ['p', 'r'] AND n.complexity IS NOT NULL RETURN n.name + ':' + n.filePath AS k", {}, [("p:/a.ts",)]),
    ("MATCH (n) WHERE (n:File OR n:Class) AND toLower(n.name) CONTAINS 'B' = false RETURN n.name AS x ORDER BY x", {}, [("a.ts",), ("b.ts",)]),
    ("MATCH (n) WHERE CASE WHEN n:File THEN n.path ELSE n.filePath END STARTS WITH '/b' RETURN n.name AS x ORDER BY x", {}, [("b.ts",), ("q",), ("s",)]),
    ("MATCH (n:Function) RETURN max(n.complexity) AS m, count(DISTINCT n.filePath) AS f, coalesce(sum(n.complexity), 0) AS s", {}, [(30, 2, 40)]),
    ("MATCH (a:Function)-[:CALLS]->(b)-[:CALLS]->(c) WHERE a.name = 's' RETURN b.name AS b, c.name AS c ORDER BY b, c", {}, [("q", "r"), ("s", "q")]),
    ("MATCH (a:Function)-[:CALLS|CONTAINS]->(b:Function), (f:File)-[:CONTAINS]->(a) RETURN f.name AS f, b.name AS b ORDER BY f, b", {}, [("a.ts", "p"), ("a.ts", "q"), ("b.ts", "q"), ("b.ts", "r"), ("b.ts", "s")]),
    ("MATCH (n:Function) WHERE n.name = 'p' RETURN n.endLine - n.startLine AS d, n.unknown AS u", {}, [(None, None)]),
]


@pytest.mark.parametrize("text,params,want", CASES)
def test_query(graph, text, params, want):
    assert rows(cypher(graph, text, params)) == want


def test_whole_values(graph):
    r = cypher(graph, "MATCH (n:File {path: '/a.ts'})-[e]->(m) RETURN n, e, m.name").collect()
    assert {x["n"]["id"] for x in r} == {"f1"} and all("_e" not in x["e"].asDict() for x in r)


def test_guards(graph):
    assert cypher(graph, "MATCH (n) WHERE n.name = 'create' RETURN count(n)").first()[0] == 0
    for bad in ("MATCH (n) DELETE n", "CREATE (n)", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (a), (b) RETURN a", "MATCH (n) RETURN m", "MATCH (n) RETURN $p", "MATCH (n)"):
        with pytest.raises(CypherError):
            cypher(graph, bad)


def test_lengths_without_an_end(spark):
    """A chain longer than any fixed bound, with a cycle at its end."""
    from pyspark.sql import functions as F

    n = 14
    nodes = spark.createDataFrame([(f"n{k}", "Function", f"n{k}") for k in range(n + 1)], "id string, label string, name string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "CALLS") for k in range(n)] + [(f"n{n}", f"n{n - 2}", "CALLS")], "src string, dst string, label string")
    g = PropertyGraph(nodes.withColumn("is_external", F.lit(False)), edges)
    ends = cypher(g, "MATCH (a {name: 'n0'})-[:CALLS*]->(b) RETURN DISTINCT b.name AS b")
    assert sorted(r.b for r in ends.collect()) == sorted(f"n{k}" for k in range(1, n + 1))
    paths = cypher(g, "MATCH p = (a {name: 'n0'})-[:CALLS*]->(b) RETURN b.name AS b, length(p) AS d")
    assert sorted((r.d, r.b) for r in paths.collect()) == [*[(k, f"n{k}") for k in range(1, n + 1)], (n + 1, f"n{n - 2}")]
    assert cypher(g, "MATCH (a {name: 'n0'})-[:CALLS*1..12]->(b) RETURN count(b)").first()[0] == 12
    assert cypher(g, "MATCH (a {name: 'n12'})-[:CALLS*]->(b) RETURN DISTINCT b.name AS b").count() == 3
    with pytest.raises(CypherError):
        cypher(g, "MATCH (a {name: 'n0'})-[:CALLS*]->(b) RETURN count(b)", max_depth=10)


def test_fulltext_call(graph):
    got = cypher(graph, "CALL db.index.fulltext.queryNodes('names', $q) YIELD node, score RETURN node.name AS n, score ORDER BY n", {"q": "p ts"})
    assert [tuple(r) for r in got.collect()] == [("a.ts", 1), ("b.ts", 1), ("p", 1)]
    for bad in ("CALL db.labels() YIELD label RETURN label", "CALL db.index.fulltext.queryNodes('x', 'y') YIELD other RETURN other"):
        with pytest.raises(CypherError):
            cypher(graph, bad)


def test_conditions_on_one_variable(graph):
    from srcweave.plans.cypher import _Query

    def tests(text):
        q = _Query(graph, text, {}, None)
        q.k = 1
        return {v: [" ".join(x for _, x in q.t[k : k + 3]) for k in at] for v, at in q._tests().items()}

    assert tests("MATCH (a)-[c]->(b) WHERE NOT b.end > 1 AND a.name = b.name AND (b:Class OR b:File) AND size(a.name) < 3 RETURN a") == {"b": ["NOT b .", "( b :"], "a": ["size ( a"]}
    assert tests("MATCH (a)-[c]->(b) WHERE b.x = 1 AND CASE WHEN a.x > 1 AND b.x > 1 THEN true ELSE false END AND b.name STARTS WITH 'q' WITH a WHERE a.x = 1 RETURN a") == {"b": ["b . x", "b . name"]}
    assert tests("MATCH (a)-[c]->(b) WHERE b.x = 1 OR a.x = 1 RETURN a") == {} == tests("MATCH (a)-[c]->(b) RETURN a")
    assert tests("MATCH (a)-[]->(on) WHERE a.x = on.x AND any(x IN a.l WHERE x = 1) AND 'RETURN OR' = a.y MATCH (b) WHERE b.x = 1 RETURN a") == {"a": ["'RETURN OR' = a"]}


FAR = [
    ("MATCH (a:Function)-[c:CALLS]->(b) WHERE b.startLine >= 20 AND c.line > 1 RETURN a.name AS a, b.name AS b, c.line AS l ORDER BY l", [("q", "r", 2), ("s", "s", 5)]),
    ("MATCH (a)-[:CALLS]-(b {name: 's'}) RETURN a.name AS a ORDER BY a", [("q",), ("s",)]),
    ("MATCH (a)<-[:CALLS]-(b)-[:CALLS]->(c) WHERE b.name = 's' AND a.name <> 'zz' RETURN a.name AS a, c.name AS c ORDER BY a", [("q", "s"), ("s", "q")]),
    ("MATCH (b:Function)<-[:CALLS]-(a) WHERE a.name = 's' AND NOT b.name = 's' RETURN b.name AS b", [("q",)]),
    ("MATCH (f:File) OPTIONAL MATCH (f)-[:CONTAINS]->(m:Function), (n)-[:CALLS]->(m) WHERE m.name = 'q' RETURN f.name AS f, count(n) AS n ORDER BY f", [("a.ts", 0), ("b.ts", 2)]),
]


@pytest.mark.parametrize("text,want", FAR)
def test_a_filtered_far_end_comes_first(graph, text, want):
    assert rows(cypher(graph, text)) == want


def test_edges_are_not_shuffled_to_a_few_far_ends(spark, graph, monkeypatch):
    from srcweave.plans import scratch

    written, real = [], scratch.materialize
    monkeypatch.setattr(scratch, "materialize", lambda df, name, *more: written.append((name, df.count())) or real(df, name, *more))
    edges = real(spark.range(400_000).selectExpr("concat('f', id) as src", "concat('f', id % 1000) as dst", "'CALLS' as label"), "edges")
    nodes = real(spark.range(400_000).selectExpr("concat('f', id) as id", "'Function' as label", "id as start_line"), "nodes")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "40")
    try:
        got = cypher(PropertyGraph(nodes, edges), "MATCH (f:Function)-[:CALLS]->(g:Function) WHERE g.startLine < 3 RETURN f.id AS id")
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert written == [("ends", 3)] and got.count() == 1200
        assert "BroadcastHashJoin" in plan.split("SortMergeJoin")[-1]
    finally:
        spark.conf.unset("spark.sql.sources.fileCompressionFactor")

"""The query language over the graph of the tables, each query against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cypher import cypher
from .cypher_writes import changes
from .roster import query
from .testgraph import Tables


def _ask(t: Tables, text: str, **params):
    return cypher(t.graph(), text, params)


@query("+p AS (SELECT min(name) AS x FROM fn) SELECT cs.src AS caller, cs.dst AS target, cs.cnt AS n FROM cs JOIN fn d ON d.id = cs.dst JOIN p ON d.name = x", "cs")
def cypher_callers(t: Tables):
    name = t.functions().agg(F.min("name")).first()[0]
    return _ask(t, "MATCH (a:Function)-[c:CALLS]->(b:Function {name: $x}) RETURN a.id AS caller, b.id AS target, c.count AS n", x=name)


@query("SELECT file_path AS file, count(*) AS n, min(start_line) AS first FROM fn GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "fn")
def cypher_grouped(t: Tables):
    return _ask(t, "MATCH (f:File)-[:CONTAINS]->(m) RETURN f.path AS file, count(m) AS n, min(m.startLine) AS first ORDER BY n DESC, file LIMIT 20")


@query("+w AS (SELECT e.dst FROM edges e JOIN fn ON fn.id = e.src WHERE e.label = 'WRITES' AND fn.start_line < 50) SELECT v.name AS variable, count(w.dst) AS writers FROM (SELECT id, name FROM nodes WHERE label = 'Variable') v LEFT JOIN w ON w.dst = v.id GROUP BY 1", "nodes", "edges")
def cypher_optional(t: Tables):
    return _ask(t, "MATCH (v:Variable) OPTIONAL MATCH (f:Function)-[:WRITES]->(v) WHERE f.startLine < 50 RETURN v.name AS variable, count(f) AS writers")


@query("+r AS (SELECT e.src, e.dst FROM edges e JOIN fn ON fn.id = e.src WHERE label = 'READS' AND fn.start_line = 7) SELECT DISTINCT r.src AS reader, e.src AS writer FROM r JOIN edges e ON e.dst = r.dst WHERE e.label = 'WRITES'", "edges")
def cypher_two_patterns(t: Tables):
    return _ask(t, "MATCH (x:Function {startLine: $l})-[:READS]->(v:Variable)<-[:WRITES]-(y:Function) RETURN DISTINCT x.id AS reader, y.id AS writer", l=7)


@query("+a AS (SELECT src, dst FROM cs WHERE sk = 3), b AS (SELECT a.src AS s, cs.dst AS e FROM a JOIN cs ON cs.src = a.dst AND NOT (cs.src = a.src AND cs.dst = a.dst)) SELECT dst AS id, 1 AS d, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT e, 2, count(*) FROM b GROUP BY 1", "cs")
def cypher_lengths(t: Tables):
    return _ask(t, "MATCH path = (a:Function {startLine: 3})-[:CALLS*1..2]->(b:Function) RETURN b.id AS id, length(path) AS d, count(*) AS n")


@query("+RECURSIVE r AS (SELECT dst AS id FROM cs WHERE sk = 3 UNION SELECT cs.dst FROM r JOIN cs ON cs.src = r.id) SELECT id FROM r", "cs")
def cypher_unbounded(t: Tables):
    return _ask(t, "MATCH (a:Function {startLine: 3})-[:CALLS*]->(b) RETURN DISTINCT b.id AS id")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
    c AS (SELECT o_custkey AS k, count(*) AS m FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), s AS (SELECT o_orderkey AS id FROM orders, c WHERE o_custkey = k ORDER BY o_orderdate, o_orderkey LIMIT 1),
    r AS (SELECT dst AS id, 1 AS d FROM n JOIN s ON s.id = src UNION ALL SELECT dst, d + 1 FROM r JOIN n ON src = r.id WHERE dst IS NOT NULL) SELECT CAST(id AS VARCHAR) AS id, d FROM r""")
def cypher_long_paths(t: Tables):
    """Paths of more relationships than any fixed bound: the orders of the customer with most, one after another."""
    from pyspark.sql import Window

    from ..operators.graph import PropertyGraph

    o = t.table("orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    most = o.groupBy("o_custkey").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "o_custkey").limit(1)
    first = o.join(most, "o_custkey").orderBy("o_orderdate", "o_orderkey").first()["id"]
    edges = o.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.lit("NEXT").alias("label")).where("dst is not null")
    g = PropertyGraph(o.select("id", F.lit("Commit").alias("label"), F.col("id").alias("name")), edges)
    return cypher(g, "MATCH p = (a:Commit {name: $x})-[:NEXT*]->(b) RETURN b.id AS id, length(p) AS d", {"x": first})


@query("+w AS (SELECT id, unnest(regexp_split_to_array(lower(name), '\\W+')) AS word FROM nodes) SELECT id, count(*) AS score FROM w WHERE word IN ('red', 'widget') GROUP BY 1 HAVING count(*) > 1", "nodes")
def cypher_fulltext(t: Tables):
    return _ask(t, "CALL db.index.fulltext.queryNodes('names', $q) YIELD node AS n, score WHERE score > 1 RETURN n.id AS id, score", q="red widget")


@query("+m AS (SELECT file_path AS f, count(*) AS n, max(start_line) AS x FROM fn GROUP BY 1 HAVING count(*) > 5) SELECT f, CASE WHEN x > 150 THEN 'late' ELSE 'early' END AS part, n + 1 AS n FROM m WHERE f LIKE '/%A%'", "fn")
def cypher_with(t: Tables):
    return _ask(t, "MATCH (n:Function) WITH n.filePath AS f, count(*) AS n, max(n.startLine) AS x WHERE n > 5 AND f CONTAINS 'A' RETURN f, CASE WHEN x > 150 THEN 'late' ELSE 'early' END AS part, n + 1 AS n")


@query("SELECT id, label AS l FROM nodes WHERE (label = 'Class' OR label = 'Variable') AND name IS NOT NULL AND name NOT LIKE 'v!_A%' ESCAPE '!'", "nodes")
def cypher_predicates(t: Tables):
    return _ask(t, "MATCH (n) WHERE (n:Class OR n:Variable) AND n.name IS NOT NULL AND NOT n.name STARTS WITH 'v_A' RETURN n.id AS id, labels(n)[0] AS l")


@query("+b AS (SELECT src, dst FROM cs WHERE sk = 5) SELECT DISTINCT CASE WHEN sk = 5 THEN cs.dst ELSE cs.src END AS id FROM cs WHERE sk = 5 OR dk = 5", "cs")
def cypher_undirected(t: Tables):
    return _ask(t, "MATCH (a:Function {startLine: 5})-[:CALLS]-(b) RETURN DISTINCT b.id AS id")


@query("+g AS (SELECT DISTINCT cs.src FROM cs JOIN fn ON fn.id = cs.dst WHERE fn.start_line < 20) SELECT id, id IN (SELECT src FROM g) AS external, CASE WHEN id IN (SELECT src FROM g) THEN start_line + 1 ELSE start_line END AS line FROM nodes WHERE label = 'Function'", "nodes", "cs")
def cypher_set(t: Tables):
    g = t.graph()
    new = changes(g, "MATCH (f:Function)-[:CALLS]->(g:Function) WHERE g.startLine < 20 SET f.isExternal = true, f.startLine = f.startLine + 1").apply(g)
    return new.nodes.where("label = 'Function'").select("id", F.col("is_external").alias("external"), F.col("start_line").alias("line"))


MERGED = """+m AS (SELECT DISTINCT 1 AS hit, 'File:' || a.file_path AS src, 'File:' || b.file_path AS dst FROM cs JOIN fn a ON a.id = cs.src JOIN fn b ON b.id = cs.dst WHERE (cs.cnt > 1 OR a.file_path = b.file_path) AND cs.src <> cs.dst),
o AS (SELECT src, dst, 1 AS hit FROM edges WHERE label = 'IMPORTS')
SELECT src, dst, CASE WHEN m.hit IS NULL THEN NULL WHEN o.hit IS NULL THEN 1 ELSE 7 END AS line FROM o FULL JOIN m USING (src, dst)"""


@query(MERGED, "edges")
def cypher_merge(t: Tables):
    g = t.graph()
    text = """MATCH (f:File)-[:CONTAINS]->(a:Function)-[c:CALLS]->(b:Function), (h:File)-[:CONTAINS]->(b) WHERE c.count > 1 OR f.path = h.path
    MERGE (f)-[r:IMPORTS]->(h) ON CREATE SET r.line = 1 ON MATCH SET r.line = $seven"""
    made = changes(g, text, {"seven": 7})
    once = made.apply(g)
    return made.apply(once).edges.where("label = 'IMPORTS'").select("src", "dst", "line")  # applied twice: nothing more changes


@query("SELECT label, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM fn WHERE start_line < 50) AND dst NOT IN (SELECT id FROM fn WHERE start_line < 50) AND NOT (label = 'READS' AND src IN (SELECT id FROM fn WHERE start_line > 100)) GROUP BY 1", "edges")
def cypher_delete(t: Tables):
    g = t.graph()
    done = changes(g, "MATCH (f:File)-[:CONTAINS]->(m:Function) WHERE m.startLine < 50 DETACH DELETE m").apply(g)
    done = changes(done, "MATCH (a:Function)-[r:READS]->(:Variable) WHERE a.startLine > 100 DELETE r").apply(done)
    return done.edges.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT 'Class:' || path || ':' || name || ':0' AS id, 'Class' AS label, name, path AS file_path, true AS is_external FROM f", "f")
def cypher_merge_nodes(t: Tables):
    g = t.graph()
    made = changes(g, "MATCH (f:File) MERGE (c:Class {name: f.name, filePath: f.path}) ON CREATE SET c.isExternal = true")
    return made.nodes.select("id", "label", "name", "file_path", "is_external")


@query("SELECT id, len(list_filter(string_split(name, ' '), lambda w: contains(w, 'e'))) AS n FROM fn", "fn")
def cypher_comprehension(t: Tables):
    return _ask(t, "MATCH (f:Function) RETURN f.id AS id, size([w IN split(f.name, ' ') WHERE w CONTAINS 'e' | toUpper(w)]) AS n").select("id", F.col("n").cast("long").alias("n"))

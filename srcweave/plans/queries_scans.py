"""Scans, filters, search, lookups and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import node_id
from ..operators import analysis as A, graph as G
from ..operators.changes import recent
from .roster import query
from .testgraph import Tables


@query("SELECT label, id, name FROM nodes WHERE label IN ('Class', 'Variable')", "nodes")
def nodes_by_label(t: Tables):
    return t.graph().scan("Class", "Variable").select("label", "id", "name")


@query("+x AS (SELECT 1) SELECT e.src, e.dst, e.label FROM edges e WHERE e.label = 'CALLS' OR e.label = 'CONTAINS'", "edges")
def edges_by_endpoint_labels(t: Tables):
    return t.graph().scan_edges(src_labels=["File", "Function"], dst_labels=["Function"]).select("src", "dst", "label")


@query("SELECT id, label FROM nodes WHERE CASE WHEN label = 'File' THEN path ELSE file_path END LIKE '/ASIA/%'", "nodes")
def nodes_prefix_scope(t: Tables):
    return t.graph().scan(prefix="/ASIA/").select("id", "label")


@query("SELECT id FROM nodes WHERE coalesce(path, file_path) LIKE '/ASIA/%' OR coalesce(path, file_path) LIKE '/EUROPE/%'", "nodes")
def nodes_multi_prefix(t: Tables):
    return t.graph().scan(prefixes=["/ASIA/", "/EUROPE/"]).select("id")


@query("SELECT id, name, label FROM nodes WHERE contains(lower(name), 'ri') OR contains(lower(coalesce(path, file_path)), 'ri') ORDER BY name, id LIMIT 50", "nodes")
def search_ci(t: Tables):
    return t.graph().search("RI", limit=50).select("id", "name", "label")


@query("SELECT id, name FROM nodes WHERE label = 'Function' AND contains(name, 'e') ORDER BY name, id LIMIT 50", "nodes")
def search_cs(t: Tables):
    return t.graph().search("e", labels=["Function"], case=True, limit=50, paths=False).select("id", "name")


@query("+p AS (SELECT min(name) AS x FROM fn) SELECT id, row_number() OVER (ORDER BY file_path, start_line, id) AS rank FROM fn, p WHERE name = x ORDER BY file_path, start_line, id LIMIT 10", "fn")
def find_symbol(t: Tables):
    name = t.table("part").agg(F.min("p_name")).first()[0]
    return G.find_symbol(t.graph(), name, "Function").select("id", F.col("rank").cast("long").alias("rank"))


@query("+t AS (SELECT id AS x FROM fn WHERE k = 7) SELECT id, label FROM nodes, t WHERE id = x UNION SELECT id, label FROM nodes WHERE path = (SELECT min(path) FROM f)", "nodes")
def entity_lookup(t: Tables):
    g = t.graph()
    fn = t.functions().where("k = 7").first()
    path = t.files().agg(F.min("path")).first()[0]
    return g.entity(fn["id"]).unionByName(g.entity(path)).select("id", "label")


@query("+m AS (SELECT min(name) AS x FROM fn) SELECT 'parts' AS form, id FROM fn WHERE k = 7 UNION ALL SELECT 'file', 'File:' || min(path) FROM f UNION ALL SELECT 'name', id FROM fn, m WHERE name = x", "fn")
def center_lookup(t: Tables):
    g, fn = t.graph(), t.functions().where("k = 7").first()
    name, path = t.functions().agg(F.min("name")).first()[0], t.files().agg(F.min("path")).first()[0]
    pick = lambda form, ref: g.center(ref).select(F.lit(form).alias("form"), "id")
    return pick("parts", fn["id"]).unionAll(pick("file", f"File:{path}")).unionAll(pick("name", name))


@query("+w AS (SELECT id, name, unnest(regexp_split_to_array(lower(name), '\\W+')) AS word FROM nodes) SELECT id, name, count(*) AS score FROM w WHERE word IN ('red', 'widget', 'blue') GROUP BY 1, 2", "nodes")
def fulltext_score(t: Tables):
    return t.graph().fulltext("Red blue WIDGET")


@query(
    """SELECT path, path LIKE '%.test.%' OR path LIKE '%.spec.%' AS by_name,
    regexp_matches(path, '\\.test\\.[jt]sx?$|\\.spec\\.[jt]sx?$|__tests__/|/tests?/|\\.tests?\\.[jt]sx?$') AS by_pattern
    FROM (SELECT replace(url, 'html', CASE page_id % 4 WHEN 0 THEN 'test.ts' WHEN 1 THEN 'spec.jsx' WHEN 2 THEN '__tests__/a.ts' ELSE 'ts' END) || CASE page_id % 3 WHEN 0 THEN '.test.ts' ELSE '/test/x' END AS path FROM pages)"""
)
def test_file_flag(t: Tables):
    m4, m3 = F.col("page_id") % 4, F.col("page_id") % 3
    ending = F.when(m4 == 0, "test.ts").when(m4 == 1, "spec.jsx").when(m4 == 2, "__tests__/a.ts").otherwise("ts")
    p = t.table("pages").select(F.concat(F.replace("url", F.lit("html"), ending), F.when(m3 == 0, ".test.ts").otherwise("/test/x")).alias("path"))
    return p.select("path", A.is_test_name(F.col("path")).alias("by_name"), A.is_test_path(F.col("path")).alias("by_pattern"))


@query("SELECT id, end_line - start_line AS span, end_line - start_line + 1 AS lines FROM fn WHERE complexity > 45", "fn")
def line_span(t: Tables):
    return t.functions().where("complexity > 45").select("id", (F.col("end_line") - F.col("start_line")).alias("span"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))


FINDINGS = """SELECT event_id AS id, event_type AS type, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity FROM events"""


def findings(t: Tables):
    e = F.col("event_type")
    severity = F.when(e == "error", "critical").when(e == "purchase", "high").when(e == "signup", "medium").when(e == "click", "low").otherwise("info")
    return t.table("events").select(F.col("event_id").alias("id"), e.alias("type"), severity.alias("severity"))


@query(f"SELECT id, severity FROM ({FINDINGS}) WHERE severity IN ('critical', 'high') AND contains(lower(type), 'r')")
def severity_filter(t: Tables):
    f = findings(t).where(A.severity_rank(F.col("severity")) >= A.SEVERITIES["high"])
    return f.where(F.lower("type").contains("r")).select("id", "severity")


@query(f"SELECT id, severity FROM ({FINDINGS}) ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, id LIMIT 100")
def severity_sorted(t: Tables):
    return findings(t).orderBy(A.severity_rank(F.col("severity")).desc(), "id").limit(100).select("id", "severity")


@query("SELECT id, label FROM nodes ORDER BY CASE WHEN label = 'File' THEN path ELSE name END, id LIMIT 20 OFFSET 40", "nodes")
def nodes_page(t: Tables):
    return t.graph().page(3, 20)[0].select("id", "label")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS INTEGER) AS total_pages, 3 < ceil(count(*) / 20.0) AS has_more FROM nodes", "nodes")
def nodes_page_total(t: Tables):
    return t.graph().page(3, 20)[1]


@query("SELECT id, complexity, end_line - start_line AS lines FROM fn WHERE complexity > 5 ORDER BY complexity DESC, id LIMIT 50", "fn")
def hotspots_service(t: Tables):
    return A.hotspots(t.functions()).select("id", "complexity", "lines")


@query("SELECT id, complexity, end_line - start_line + 1 AS lines FROM fn WHERE complexity >= 10 ORDER BY complexity DESC, id LIMIT 50", "fn")
def hotspots_tool(t: Tables):
    return A.hotspots(t.functions(), 10, strict=False).select("id", "complexity", "lines")


@query("SELECT round(avg(complexity), 1) AS avg_complexity, max(complexity) AS max_complexity, count(*) AS shown FROM (SELECT complexity FROM fn WHERE complexity > 5 ORDER BY complexity DESC, id LIMIT 50)", "fn")
def hotspot_summary(t: Tables):
    return A.hotspots(t.functions()).agg(F.round(F.avg("complexity"), 1).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.count("*").alias("shown"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def commits_recent(t: Tables):
    commits = t.table("orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"))
    return recent(commits, 25)


@query("SELECT id, split_part(id, ':', 1) AS label, split_part(id, ':', 3) AS name, CAST(split_part(id, ':', 4) AS BIGINT) AS line FROM fn", "fn")
def id_parse(t: Tables):
    parts = F.split("id", ":")
    fn = t.functions().withColumn("id", node_id("Function", F.col("file_path"), F.col("name"), F.col("start_line")))
    return fn.select("id", parts[0].alias("label"), parts[2].alias("name"), parts[3].cast("long").alias("line"))

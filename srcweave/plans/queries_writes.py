"""Upserts and deletes as transforms of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C, graph as G, upsert as U
from .queries_paths import BUSY, busiest
from .roster import query
from .testgraph import Tables


@query(
    """WITH cur AS (SELECT s_suppkey AS k, s_name AS name, CAST(s_acctbal AS DOUBLE) AS v FROM supplier), b AS (SELECT 2 * l_suppkey AS k, l_returnflag AS name, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_quantity END AS v, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS seq FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, name, v) AS n FROM b) SELECT k, name, v FROM r WHERE n = 1 AND k IN (SELECT k FROM b) UNION ALL SELECT k, name, v FROM cur WHERE k NOT IN (SELECT k FROM b)"""
)
def upsert_last_wins(t: Tables):
    cur = t.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"))
    li = t.table("lineitem")  # keys are doubled: odd ones stay as they are, those beyond the suppliers are new
    seq = (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq")
    batch = li.select((2 * F.col("l_suppkey")).alias("k"), F.col("l_returnflag").alias("name"), F.when(F.col("l_linestatus") != "F", F.col("l_quantity")).alias("v"), seq)
    return U.upsert(cur, batch, ["k"]).select("k", "name", "v")


@query("WITH a AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k FROM lineitem), c AS (SELECT a.k AS src, b.k AS dst, min(a.n) AS line, count(*) AS count FROM a JOIN a b ON a.o = b.o AND b.n = a.n + 1 GROUP BY 1, 2) SELECT src, dst, line, count FROM c WHERE count > 1")
def calls_merge_count(t: Tables):
    li = t.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"))
    b = li.select("o", (F.col("n") - 1).alias("n"), F.col("k").alias("dst"))
    calls = li.withColumnRenamed("k", "src").join(b, ["o", "n"]).withColumns({"line": F.col("n"), "seq": F.col("n")})
    return U.merge_calls(calls).where("count > 1")


@query("+t AS (SELECT DISTINCT b.file_path AS path FROM cs JOIN fn b ON b.id = dst), kept AS (SELECT path FROM f WHERE s_suppkey % 3 <> 0) SELECT path, false AS is_external FROM kept UNION ALL SELECT path, true FROM t WHERE path NOT IN (SELECT path FROM kept)", "cs")
def import_stubs(t: Tables):
    fn = t.functions()
    c = t.calls().join(fn.select(F.col("id").alias("src"), F.col("file_path").alias("from_path")), "src").join(fn.select(F.col("id").alias("dst"), F.col("file_path").alias("to_path")), "dst")
    imports = c.select("from_path", "to_path", F.lit("x").alias("specifiers"), F.col("line").alias("seq"))
    return U.import_stubs(t.files().where("s_suppkey % 3 <> 0").select("path"), imports)[0].select("path", "is_external")


@query("WITH k AS (SELECT n_nationkey AS n, n_name AS name, '/' || r_name || '/' || n_name || '.ts' AS fp FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT CASE WHEN n % 4 = 0 THEN name || 'Base' ELSE name END AS name, CASE WHEN n % 4 = 0 THEN 'external' ELSE fp || 'x' END AS file_path FROM k WHERE n % 4 < 2")
def inherit_stubs(t: Tables):
    k, n = t.classes(), F.col("n_nationkey") % 4
    name = F.when(n == 0, F.concat("name", F.lit("Base"))).otherwise(F.col("name")).alias("to_name")
    file = F.when(n == 1, F.concat("file_path", F.lit("x"))).when(n > 1, F.col("file_path")).alias("to_file")
    return U.inherit_stubs(k, k.select(F.col("id").alias("src"), name, file))[0].select("name", "file_path")


@query("SELECT 'S' || l_suppkey AS src_id, 'O' || l_orderkey AS dst_id, CAST(sum(l_quantity) AS BIGINT) AS lines_added FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def modified_in_upsert(t: Tables):
    refs = t.table("lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("commit")).agg(F.sum("l_quantity").cast("long").alias("lines_added"))
    files = t.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("key"))
    commits = t.table("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("key"))
    return U.match_ends(refs, files, commits, ["file"], ["commit"], ["key"]).select("src_id", "dst_id", "lines_added")


@query("+r AS (SELECT DISTINCT a.name AS sn, a.file_path AS sf, b.name AS dn, b.file_path AS df FROM cs JOIN fn a ON a.id = src JOIN fn b ON b.id = dst) SELECT a.id AS src_id, b.id AS dst_id FROM r JOIN fn a ON a.name = sn AND a.file_path = sf JOIN fn b ON b.name = dn AND b.file_path = df", "cs")
def flows_by_name_and_file(t: Tables):
    fn = t.functions().select("id", "name", "file_path")
    c = t.calls().join(fn.toDF("src", "sn", "sf"), "src").join(fn.toDF("dst", "dn", "df"), "dst").select("sn", "sf", "dn", "df").distinct()
    return U.match_ends(c, fn, fn, ["sn", "sf"], ["dn", "df"], ["name", "file_path"]).select("src_id", "dst_id")


@query("+a AS MATERIALIZED (SELECT * FROM edges), w AS (SELECT 'File:' || path AS id FROM f WHERE s_suppkey % 2 = 0), g AS MATERIALIZED (SELECT id FROM w UNION SELECT dst FROM a WHERE label = 'CONTAINS' AND src IN (SELECT id FROM w)) SELECT src, dst, label FROM a ANTI JOIN g ON a.src = g.id ANTI JOIN g AS h ON a.dst = h.id", "edges")
def delete_file_cascade(t: Tables):
    paths = t.files().where("s_suppkey % 2 = 0").select("path")
    return U.delete_files(t.graph(), paths).edges.select("src", "dst", "label")


@query("SELECT id FROM nodes WHERE NOT (label = 'File' AND path LIKE '/ASIA/%') AND NOT (label = 'Function' AND file_path LIKE '/ASIA/%')", "nodes")
def delete_project_cascade(t: Tables):
    g = t.graph()
    none = [F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("count")]
    has = t.files().select(F.concat(F.lit("Project:"), "project").alias("src"), F.concat(F.lit("File:"), "path").alias("dst"), F.lit("HAS_FILE").alias("label"), *none)
    p = t.table("region").select(F.concat(F.lit("Project:"), "r_name").alias("id"), F.lit("Project").alias("label"), F.col("r_name").alias("name"))
    full = G.PropertyGraph(g.nodes.unionByName(p, allowMissingColumns=True), g.edges.unionByName(has))
    return U.delete_project(full, "Project:ASIA").nodes.where("label <> 'Project'").select("id")


@query("SELECT 'p' AS src, 'File:' || path AS dst FROM f", "f")
def link_project_files(t: Tables):
    f = t.files()
    links = U.link_files(t.spark.createDataFrame([], "src string, dst string"), "p", f.where("s_suppkey % 2 = 0").select("path"))
    return U.link_files(links, "p", f.select("path"))


@query("SELECT DISTINCT src.id AS src, d.id AS dst FROM cs JOIN fn src ON src.id = cs.src JOIN fn t ON t.id = cs.dst JOIN fn d ON d.name = t.name", "cs")
def renders_by_name(t: Tables):
    fn = t.functions().select("id", "name")
    refs = t.calls().join(fn.select(F.col("id").alias("dst"), F.col("name").alias("child")), "dst").select("src", "child", "line")
    return U.renders(refs, fn).select("src", "dst")


@query(f"+{BUSY}, n AS (SELECT id FROM b UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM b) UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM b)) SELECT DISTINCT src, dst, label FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)", "edges")
def focus_graph(t: Tables):
    g, b = t.graph(), busiest(t)
    start = g.nodes.join(b, "id", "left_semi")
    more = g.nodes.join(g.expand(b, direction="both").select(F.col("other").alias("id")), "id", "left_semi")
    return G.focus(start, more, g.edges).edges.select("src", "dst", "label")


@query("SELECT path, hash FROM (SELECT 'd/' || doc_id AS path, substr(sha256(text), 1, 16) AS hash, doc_id FROM documents) WHERE doc_id % 4 = 1 OR doc_id % 4 = 2")
def projects_set_operations(t: Tables):
    d = t.table("documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), C.content_hash(F.col("text")).alias("hash"), "doc_id")
    pick = lambda *k: d.where((F.col("doc_id") % 4).isin(*k)).select("path", "hash")
    active = pick(0, 1).unionAll(pick(1, 2)).distinct()
    return active.join(pick(0), ["path"], "left_anti")

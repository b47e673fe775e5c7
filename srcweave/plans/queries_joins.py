"""One-hop joins, resolution joins and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A, changes as C, graph as G, resolve as R
from ..operators.sections import section_spans
from .queries_paths import BUSY, busiest
from .roster import query
from .testgraph import Tables


@query("+p AS (SELECT min(d.name) AS x FROM cs JOIN fn d ON d.id = cs.dst) SELECT s.id AS caller, cs.dst AS target, cs.line FROM cs JOIN fn d ON d.id = cs.dst JOIN p ON d.name = x JOIN fn s ON s.id = cs.src", "cs")
def callers_by_name(t: Tables):
    called = t.functions().join(t.calls().select(F.col("dst").alias("id")), "id", "left_semi")
    name = called.agg(F.min("name")).first()[0]
    g = t.graph()
    hits = g.expand(g.scan("Function").where(F.col("name") == name).select("id"), ["CALLS"], "in")
    return hits.select(F.col("other").alias("caller"), F.col("id").alias("target"), F.col("edge_line").cast("int").alias("line"))


def _with_more(t: Tables) -> G.PropertyGraph:
    """The graph with EXPORTS of the functions of even complexity, and INSTANTIATES from each function to its folder's class."""
    fn, line, none = t.functions(), F.lit(1).alias("line"), F.lit(None).cast("long").alias("count")
    exports = fn.where("complexity % 2 = 0").select(F.concat(F.lit("File:"), "file_path").alias("src"), F.col("id").alias("dst"), F.lit("EXPORTS").alias("label"), line, none)
    classes = t.classes().select(F.col("id").alias("dst"), F.col("file_path").alias("folder"))
    made = fn.withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ".ts")).join(classes, "folder").select(F.col("id").alias("src"), "dst", F.lit("INSTANTIATES").alias("label"), F.col("start_line").cast("int").alias("line"), none)
    g = t.graph()
    return G.PropertyGraph(g.nodes, g.edges.unionByName(exports).unionByName(made))


@query("SELECT id, name FROM fn WHERE complexity % 2 = 0 AND file_path = (SELECT min(path) FROM f)", "fn")
def file_exports(t: Tables):
    return _with_more(t).exports(_first_file(t).removeprefix("File:")).select("id", "name")


@query("+n AS (SELECT min(split_part(file_path, '/', 3)) AS x FROM fn) SELECT fn.id, start_line AS line FROM fn, n WHERE split_part(file_path, '/', 3) = x", "fn")
def class_instantiations(t: Tables):
    name = t.functions().agg(F.min(F.split("file_path", "/")[2])).first()[0]
    return _with_more(t).instantiations(name).select("id", F.col("line").cast("long").alias("line"))


SUB = """+x AS (SELECT 'File:' || min(path) AS id FROM f), i AS (SELECT dst AS id FROM edges, x WHERE src = x.id AND label = 'CONTAINS'),
w AS (SELECT id FROM x UNION SELECT id FROM i), a AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM i) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM i))"""


def _first_file(t: Tables) -> str:
    return "File:" + t.files().agg(F.min("path")).first()[0]


@query(f"{SUB} SELECT id FROM w UNION SELECT id FROM a", "edges")
def file_subgraph_nodes(t: Tables):
    return t.graph().file_subgraph(_first_file(t)).nodes.select("id")


@query(f"{SUB} SELECT DISTINCT src, dst, label FROM edges WHERE src IN (SELECT id FROM w) OR dst IN (SELECT id FROM i)", "edges")
def file_subgraph_edges(t: Tables):
    return t.graph().file_subgraph(_first_file(t)).edges.select("src", "dst", "label")


def _neighbors(direction: str):
    ends = {"out": "SELECT dst AS id FROM e WHERE src IN (SELECT id FROM b)", "in": "SELECT src AS id FROM e WHERE dst IN (SELECT id FROM b)"}
    ends["both"] = f"{ends['out']} UNION {ends['in']}"
    body = f"+{BUSY}, e AS (SELECT * FROM edges WHERE label IN ('CALLS', 'READS', 'CONTAINS')), n AS ({ends[direction]}) SELECT DISTINCT id FROM n WHERE id NOT IN (SELECT id FROM b)"

    def run(t: Tables):
        return t.graph().neighbors(busiest(t), direction, ["CALLS", "READS", "CONTAINS"]).select("id")

    run.__name__ = f"neighbors_{direction}"
    query(body, "edges")(run)


for _d in ("out", "in", "both"):
    _neighbors(_d)


@query(
    f"+{BUSY}, h AS (SELECT b.id AS id, 0 AS d FROM b UNION SELECT dst, 1 FROM edges, b WHERE src = b.id UNION SELECT src, 1 FROM edges, b WHERE dst = b.id), "
    "h2 AS (SELECT id, d FROM h UNION SELECT dst, 2 FROM edges JOIN h ON src = h.id WHERE d = 1 UNION SELECT src, 2 FROM edges JOIN h ON dst = h.id WHERE d = 1) "
    "SELECT id, min(d) AS depth FROM h2 WHERE id NOT IN (SELECT id FROM b) GROUP BY id ORDER BY 2, 1 LIMIT 100",
    "edges",
)
def neighbors_two_hops(t: Tables):
    return t.graph().neighbors(busiest(t), "both", depth=2, limit=100).select("id", "depth")


@query(f"+{BUSY} SELECT DISTINCT b.id, 'out' AS direction, label AS type, dst AS other FROM edges, b WHERE src = b.id UNION SELECT DISTINCT b.id, 'in', label, src FROM edges, b WHERE dst = b.id", "edges")
def entity_connections(t: Tables):
    return t.graph().connections(busiest(t))


@query("+p AS (SELECT id FROM nodes ORDER BY id LIMIT 400) SELECT src, dst, label FROM edges WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)", "nodes", "edges")
def full_graph_edges(t: Tables):
    return t.graph().full(400).edges.select("src", "dst", "label")


@query("+s AS (SELECT cs.src, count(DISTINCT cs.dst) AS n FROM cs JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.file_path = b.file_path GROUP BY 1) SELECT fn.id, coalesce(n, 0) AS internal_calls FROM fn LEFT JOIN s ON s.src = fn.id", "cs")
def optional_internal_calls(t: Tables):
    return A.internal_calls(t.functions(), t.calls())


@query("SELECT id FROM fn WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.dst = fn.id AND cs.line = 1)", "cs")
def untested_callers_anti(t: Tables):
    return G.without_edges(t.functions().select("id"), t.calls().where("line = 1"))


@query("SELECT cs.src AS id, v.dst AS variable FROM cs JOIN edges v ON v.src = cs.dst WHERE v.label = 'READS' GROUP BY 1, 2", "edges")
def readers_of_callees(t: Tables):
    reads = t.accesses("READS").select(F.col("src").alias("f"), F.col("dst").alias("variable"))
    c = t.calls()
    return c.join(reads, c["dst"] == reads["f"]).select(F.col("src").alias("id"), "variable").distinct()


@query("SELECT dst AS variable, label, count(*) AS functions FROM edges WHERE label IN ('READS', 'WRITES') GROUP BY 1, 2", "edges")
def variable_access(t: Tables):
    return G.accessors(t.edges()).select(F.col("id").alias("variable"), "label", F.col("n").alias("functions"))


# resolution: references are calls by name; files import the files that they call
IMPORTS = """+d AS (SELECT file_path, name FROM fn GROUP BY 1, 2), im AS (SELECT a.file_path AS fp, b.name AS local, min(b.file_path) AS tf FROM cs JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.file_path <> b.file_path GROUP BY 1, 2),
refs AS (SELECT a.id AS caller, a.file_path AS fp, b.name AS name FROM cs JOIN fn a ON a.id = src JOIN fn b ON b.id = dst)"""


def _refs(t: Tables):
    fn = t.functions().select("id", "file_path", "name", "k")
    c = t.calls().select("src", "dst")
    a, b = fn.select(F.col("id").alias("src"), "file_path"), fn.select(F.col("id").alias("dst"), "name", F.col("file_path").alias("to"), "k")
    both = c.join(a, "src").join(b, "dst")
    imports = both.where("file_path <> to").select("file_path", F.col("name").alias("local"), F.col("name").alias("source_name"), F.col("to").alias("resolved_path"))
    return both.select(F.col("src").alias("caller"), "file_path", "name"), imports, fn


@query(f"{IMPORTS} SELECT caller, refs.name, CASE WHEN d.name IS NOT NULL THEN refs.fp ELSE tf END AS to_file, CASE WHEN d.name IS NOT NULL THEN 'local' WHEN tf IS NOT NULL THEN 'imported' ELSE 'unresolved' END AS kind FROM refs LEFT JOIN d ON d.file_path = refs.fp AND d.name = refs.name LEFT JOIN im ON im.fp = refs.fp AND im.local = refs.name", "cs")
def call_resolution(t: Tables):
    refs, imports, fn = _refs(t)
    return R.resolve_names(refs, fn, imports).select("caller", "name", "to_file", "kind")


CLASS = "WITH k AS (SELECT n_nationkey AS n, n_name AS name, '/' || r_name || '/' || n_name || '.ts' AS fp FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"{CLASS} SELECT a.name AS child, b.name AS parent, CASE WHEN b.fp IS NULL THEN 'unresolved' WHEN a.fp = b.fp THEN 'local' ELSE 'imported' END AS kind FROM k a JOIN (SELECT *, CASE WHEN n % 7 = 0 THEN 'Nowhere' END AS x FROM k) c ON c.n = a.n LEFT JOIN k b ON b.n = (a.n * 3) % 25 AND c.x IS NULL")
def inheritance_resolution(t: Tables):
    k = t.classes().select("n_nationkey", "name", "file_path")
    parent = k.select(F.col("n_nationkey").alias("p"), F.col("name").alias("pn"), F.col("file_path").alias("pf"))
    refs = k.join(parent, (k.n_nationkey * 3) % 25 == parent.p)
    refs = refs.withColumn("to", F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit("Nowhere"), "name")).otherwise(F.col("pn")))
    imports = refs.where("file_path <> pf and n_nationkey % 7 <> 0").select("file_path", F.col("to").alias("local"), F.col("pn").alias("source_name"), F.col("pf").alias("resolved_path"))
    out = R.resolve_names(refs.select(F.col("name").alias("child"), "file_path", F.col("to").alias("name")), k, imports)
    return out.select("child", F.col("to_name").alias("parent"), "kind")


@query("+d AS (SELECT DISTINCT name FROM fn), r AS (SELECT b.name || CASE WHEN b.k % 5 = 0 THEN '?' ELSE '' END AS name FROM cs JOIN fn b ON b.id = dst) SELECT count(*) AS \"references\", count(d.name) AS resolved, count(*) - count(d.name) AS unresolved, (SELECT count(*) FROM fn) AS symbols FROM r LEFT JOIN d ON d.name = r.name", "cs")
def symbol_resolve_counts(t: Tables):
    fn = t.functions().select("id", "name", "k")
    refs = t.calls().select(F.col("dst").alias("id")).join(fn, "id")
    return R.count_resolved(refs.withColumn("name", F.concat("name", F.when(F.col("k") % 5 == 0, "?").otherwise(""))), fn)


ENDINGS = "'.ts', '.tsx', '.js', '.jsx', '.mts', '.cts', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mts', '/index.cts', '/index.mjs', '/index.cjs'"


@query(
    f"""+i AS (SELECT a.path AS file_path, '../' || b.nn || '/' || CASE b.s % 3 WHEN 0 THEN replace(b.name, '.ts', '.js') WHEN 1 THEN replace(b.name, '.ts', '') ELSE 'missing' END AS source, '/' || a.project || '/' || b.nn || '/' AS dir, CASE b.s % 3 WHEN 0 THEN replace(b.name, '.ts', '.js') WHEN 1 THEN replace(b.name, '.ts', '') ELSE 'missing' END AS base, b.s % 3 AS m
    FROM f a JOIN (SELECT f.*, n_name AS nn, s_suppkey AS s FROM f JOIN nation ON n_nationkey = nk) b ON b.project = a.project AND b.s_suppkey = a.s_suppkey + 1 - (a.s_suppkey + 1) % 2),
    e AS (SELECT unnest([{ENDINGS}]) AS x, unnest(range(16)) AS pos),
    c AS (SELECT i.*, CASE WHEN m = 0 THEN dir || replace(base, '.js', '.ts') ELSE dir || base || x END AS cand, pos FROM i, e WHERE m <> 0 OR pos = 0)
    SELECT i.file_path, i.source, (SELECT arg_min(cand, pos) FROM c JOIN f ON f.path = c.cand WHERE c.file_path = i.file_path AND c.source = i.source) AS resolved_path FROM i""",
    "f",
)
def import_candidates(t: Tables):
    f = t.files().join(t.table("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(t.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    a = f.select(F.col("path").alias("file_path"), "project", (F.col("s_suppkey") + 1 - (F.col("s_suppkey") + 1) % 2).alias("k"))
    b = f.select(F.col("s_suppkey").alias("k"), F.col("project").alias("bp"), "n_name", "name")
    m = F.col("k") % 3
    base = F.when(m == 0, F.replace("name", F.lit(".ts"), F.lit(".js"))).when(m == 1, F.replace("name", F.lit(".ts"), F.lit(""))).otherwise("missing")
    i = a.join(b, "k").where("project = bp").select("file_path", F.concat(F.lit("../"), "n_name", F.lit("/"), base).alias("source"))
    return R.resolve_imports(i, t.files()).select("file_path", "source", "resolved_path")


LISTS = """WITH a AS (SELECT 'd/' || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 2000000 ELSE 0 END) AS path, substr(sha256(text), 1, 16) AS hash FROM documents),
b AS (SELECT 'd/' || (doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000 ELSE 0 END) AS path, substr(sha256(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END), 1, 16) AS hash FROM documents),
ch AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'modified' ELSE 'unchanged' END AS type, b.hash AS hash, a.hash AS previous_hash FROM a FULL JOIN b ON a.path = b.path)"""
RENAMES = """, g AS (SELECT path, previous_hash AS h, row_number() OVER (PARTITION BY previous_hash ORDER BY path) AS n FROM ch WHERE type = 'deleted'),
w AS (SELECT path, hash AS h, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM ch WHERE type = 'added'),
p AS (SELECT g.path AS old_path, w.path AS new_path, g.h FROM g JOIN w ON g.h = w.h AND g.n = w.n),
r AS (SELECT path, type, hash, previous_hash, NULL AS old_path FROM ch WHERE NOT (type = 'deleted' AND path IN (SELECT old_path FROM p)) AND NOT (type = 'added' AND path IN (SELECT new_path FROM p)) UNION ALL SELECT new_path, 'renamed', h, h, old_path FROM p)"""


def listings(t: Tables):
    d, i = t.table("documents").select("doc_id", "text"), F.col("doc_id")
    name = lambda c: F.concat(F.lit("d/"), c.cast("string")).alias("path")
    stored = d.select(name(i + F.when(i % 3 == 0, 2000000).otherwise(0)), C.content_hash(F.col("text")).alias("hash"))
    moved = i + F.when(i % 7 == 0, 1000000).otherwise(0)
    return stored, d.select(name(moved), C.content_hash(F.concat("text", F.when(i % 5 == 0, "x").otherwise(""))).alias("hash"))


@query(f"{LISTS} SELECT * FROM ch")
def change_detect(t: Tables):
    return C.detect_changes(*listings(t))


@query(f"{LISTS}{RENAMES} SELECT * FROM r")
def rename_match(t: Tables):
    return C.match_renames(C.detect_changes(*listings(t)))


@query(f"{LISTS}{RENAMES} SELECT count(*) AS total, count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'modified') AS modified, count(*) FILTER (type = 'deleted') AS deleted, count(*) FILTER (type = 'renamed') AS renamed, count(*) FILTER (type = 'unchanged') AS unchanged, count(*) FILTER (type IN ('added', 'modified', 'renamed')) AS to_process FROM r")
def change_summary(t: Tables):
    return C.summary(C.match_renames(C.detect_changes(*listings(t))))


@query(
    """WITH s AS (SELECT user_id AS file, event_id AS source, event_type AS variable FROM events WHERE event_type IN ('view', 'click', 'error')),
    k AS (SELECT user_id AS file, event_id AS sink, event_type || '(' || CASE event_id % 5 WHEN 0 THEN 'escape(click)' WHEN 1 THEN 'view + x' WHEN 2 THEN 'error' ELSE 'none' END || ')' AS argument FROM events)
    SELECT s.file, source, sink FROM s JOIN k ON s.file = k.file WHERE contains(argument, variable) AND NOT contains(argument, 'escape')"""
)
def taint_theta_join(t: Tables):
    e = t.table("events")
    s = e.where("event_type in ('view', 'click', 'error')").select(F.col("user_id").alias("file"), F.col("event_id").alias("source"), F.col("event_type").alias("variable"))
    m = F.col("event_id") % 5
    arg = F.when(m == 0, "escape(click)").when(m == 1, "view + x").when(m == 2, "error").otherwise("none")
    k = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("sink"), F.concat("event_type", F.lit("("), arg, F.lit(")")).alias("argument"))
    return R.taint_matches(s, k, ("escape", "sanitize")).select("file", "source", "sink")


@query(
    """WITH l AS (SELECT page_id, '/site/p' || page_id || '/page.html' AS file_path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
    SELECT page_id, target, NOT regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:|^//') AS is_internal,
    CASE WHEN regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:|^//') THEN NULL WHEN regexp_replace(target, '#.*$', '') = '' THEN file_path WHEN starts_with(target, '/') THEN regexp_replace(regexp_replace(target, '#.*$', ''), '/$', '') ELSE '/site/p' || page_id || '/' || regexp_replace(target, '#.*$', '') END AS resolved FROM l"""
)
def link_resolution(t: Tables):
    p = t.table("pages")
    path = F.concat(F.lit("/site/p"), F.col("page_id").cast("string"), F.lit("/page.html")).alias("file_path")
    links = p.select("page_id", path, F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return R.resolve_links(links).select("page_id", "target", "is_internal", "resolved")


@query("SELECT r.r_name AS project, n.id FROM region r JOIN nodes n ON coalesce(n.path, n.file_path) LIKE '/' || r.r_name || '/%'", "nodes")
def project_scope(t: Tables):
    roots = t.table("region").select(F.col("r_name").alias("project"), F.concat(F.lit("/"), "r_name").alias("root"))
    return G.in_projects(t.nodes(), roots).select("project", "id")


@query(
    """WITH e AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations), u AS (SELECT conv_id, word, min(turn) AS first_turn, count(*) AS n FROM e GROUP BY 1, 2),
    r AS (SELECT conv_id, string_split(text, ' ')[1] AS head, string_split(text, ' ')[2] AS tail FROM conversations)
    SELECT r.conv_id, head, tail, h.first_turn AS head_turn, t.first_turn AS tail_turn FROM r JOIN u h ON h.conv_id = r.conv_id AND h.word = head JOIN u t ON t.conv_id = r.conv_id AND t.word = tail"""
)
def annotations_resolve(t: Tables):
    from ..functions.nlp import resolve_relations

    c = t.table("conversations")
    e = c.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("id"), F.explode(F.split("text", " ")).alias("text"))
    words = F.split("text", " ")
    r = c.select(F.col("conv_id").alias("sample_id"), words[0].alias("head"), F.try_element_at(words, F.lit(2)).alias("tail"))
    return resolve_relations(r, e).select(F.col("sample_id").alias("conv_id"), "head", "tail", F.col("head_id").alias("head_turn"), F.col("tail_id").alias("tail_turn"))


@query(
    """WITH q AS (SELECT page_id, regexp_extract_all(html, '<(h1|ul|li|a|p|b)[ >]', 1) AS tags FROM pages),
    l AS (SELECT page_id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS line, len(tags) AS n FROM q),
    v AS (SELECT *, CASE tag WHEN 'h1' THEN 1 WHEN 'ul' THEN 2 WHEN 'li' THEN 3 WHEN 'a' THEN 4 WHEN 'p' THEN 5 ELSE 6 END AS level FROM l)
    SELECT v.page_id, v.line, v.level, coalesce(CAST(min(b.line) FILTER (b.line > v.line AND b.level <= v.level) - 1 AS INTEGER), CAST(v.n AS INTEGER)) AS end_line, max(b.line) FILTER (b.line < v.line AND b.level < v.level) AS parent
    FROM v JOIN v b ON b.page_id = v.page_id GROUP BY v.page_id, v.line, v.level, v.n"""
)
def page_outline(t: Tables):
    """Elements of web pages by rank: where each ends, and under which it stands."""
    tags = t.table("pages").select("page_id", F.regexp_extract_all("html", F.lit("<(h1|ul|li|a|p|b)[ >]"), F.lit(1)).alias("tags"))
    rows = tags.select(F.col("page_id").alias("file_path"), F.posexplode("tags").alias("k", "tag"))
    level = F.when(F.col("tag") == "h1", 1).when(F.col("tag") == "ul", 2).when(F.col("tag") == "li", 3).when(F.col("tag") == "a", 4).when(F.col("tag") == "p", 5).otherwise(6)
    rows = rows.select("file_path", (F.col("k") + 1).cast("long").alias("start_line"), level.alias("level"), (F.col("k") + 1).cast("long").alias("id"))
    out = section_spans(rows, tags.select(F.col("page_id").alias("file_path"), F.size("tags").alias("lines")), part=16)
    return out.select(F.col("file_path").alias("page_id"), F.col("start_line").alias("line"), "level", "end_line", F.col("parent_id").alias("parent"))

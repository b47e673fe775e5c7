"""Sources, extractors, rules, indexing and events over the sample project; the expected rows are stated by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nlp
from ..operators import analysis as A, resolve as R
from ..operators.ingest import extract, link, reindex, rows_of
from ..operators.sections import section_spans
from ..service import Service
from ..sources import files as S
from . import sample_project as P, scratch
from .roster import example, query
from .testgraph import Tables


def _values(names: str, *rows: tuple) -> str:
    """SQL that is these rows."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def _base(c: str = "file_path") -> Column:
    return F.element_at(F.split(c, "/"), -1).alias("file")


def _short(c: str) -> Column:
    """An id without its root: label, file and name."""
    return F.regexp_replace(F.regexp_replace(c, f"{P.ROOT}/(\\w+/)?", ""), ":[0-9]+$", "")


# sources -----------------------------------------------------------------------------------------------------------
def _paths(df: DataFrame, root: str) -> DataFrame:
    return df.select(F.expr(f"substring(path, locate('{root.rsplit('/', 1)[1]}', path) + {len(root.rsplit('/', 1)[1])})").alias("path"), F.length("content").cast("int").alias("size"))


def _sizes(*endings: str) -> str:
    return _values("path, size", *[("/" + k, len(v)) for k, v in P.FILES.items() if k.endswith(endings)])


@example(_sizes(".ts", ".tsx", ".py", ".cs"))
def source_tree_scan(t: Tables):
    root = P.tree(t.spark)
    return _paths(S.scan(t.spark, root), root)


@example(_sizes(".ts", ".tsx"))
def analytics_scan(t: Tables):
    root = P.tree(t.spark)
    return _paths(S.analytics_scan(t.spark, root), root)


@example(_values("path, size", ("/lib/index.ts", len(P.FILES["lib/index.ts"]))))
def vulnerability_scan_of_a_file(t: Tables):
    root = P.tree(t.spark)
    return _paths(S.vulnerability_scan(t.spark, f"{root}/lib/index.ts"), root)


@example(_values("path, kind, name", ("lib/index.ts", "Class", "Base"), ("lib/index.ts", "File", "index.ts"), ("lib/index.ts", "Function", "load"), ("lib/index.ts", "Interface", "Saver"), ("py/util.py", "File", "util.py"), ("py/util.py", "Function", "helper")))
def extract_command(t: Tables):
    """Relative paths and md5 of a folder's files that match, with what they define."""
    out = S.extract_rows(P.files(t.spark), P.ROOT, include=("lib/*", "py/util*"), exclude=("*.tsx",))
    return out.where("length(hash) = 32").select("path", "kind", "name")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations")
def jsonl_save_append_load(t: Tables):
    path, c = scratch.new_path(t.spark, "jsonl"), t.table("conversations").select("conv_id", "turn", "role", "text")
    S.write_jsonl(c, path)
    S.write_jsonl(c, path, append=True)
    return S.read_jsonl(t.spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, text, CASE WHEN role = 'user' THEN 'chat' ELSE 'jsonl' END AS source FROM conversations WHERE text IS NOT NULL")
def jsonl_messages(t: Tables):
    path, c = scratch.new_path(t.spark, "messages"), t.table("conversations")
    S.write_jsonl(c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.when(F.col("role") == "user", "chat").alias("source")), path)
    return S.read_messages(t.spark, path).select("id", "text", "source")


@example(_values("text, body, k", ("one", " one ", 1), ("two", "two", 2)))
def json_array_import(t: Tables):
    path = scratch.new_path(t.spark, "array") + ".json"
    scratch.write_text(t.spark, path, '[{"body": " one ", "k": 1}, {"body": ""},\n {"body": "two", "k": 2}]')
    x = F.from_json(F.element_at("metadata", "object"), "body string, k int")
    return nlp.from_json_array(t.spark, path, "body").select("text", x["body"].alias("body"), x["k"].alias("k"))


@example(_values("text, source, same", ("alice met bob", "list", True), ("boom", "list", True)))
def string_list_import(t: Tables):
    got = nlp.from_strings(t.spark, [" alice met bob ", "", "boom"], source="list", created_at="now")
    return got.select("text", "source", (F.col("id") == F.substring(F.sha2("text", 256), 1, 32)).alias("same"))


@query("SELECT conv_id || ',' || turn || ',' || role AS line FROM (SELECT '\"' || conv_id || '\"' AS conv_id, '\"' || turn || '\"' AS turn, '\"' || role || '\"' AS role FROM conversations)")
def csv_result(t: Tables):
    path = scratch.new_path(t.spark, "csv")
    S.write_result(t.table("conversations").select("conv_id", "turn", "role"), path, "csv")
    return t.spark.read.text(path).where("value not like '%conv_id%'").select(F.col("value").alias("line"))


@example(_values("line", ("name | n",), ("---- | --",), ("ab   | 1",), ("c    | 22",)))
def table_result(t: Tables):
    rows = t.spark.createDataFrame([("ab", 1), ("c", 22)], "name string, n int")
    return t.spark.createDataFrame([(x,) for x in S.as_table(rows.orderBy("n")).split("\n")], "line string")


# extractors --------------------------------------------------------------------------------------------------------
def _rows(t: Tables, kind: str, like: str = "%.ts%") -> DataFrame:
    return P.snapshot(t.spark).table(kind).where(F.col("file_path").like(like))


@example(_values("file, source, def, ns, names", ("store.ts", "./people", None, None, "Person>,makePerson>make"), ("store.ts", "fs", None, "fs", ""), ("store.ts", "../lib", "Base", None, ""), ("View.tsx", "react", "React", None, ""), ("View.tsx", "./Row", None, None, "Row>")))
def ts_imports(t: Tables):
    names = F.array_join(F.transform("specifiers", lambda x: F.concat(x["name"], F.lit(">"), F.coalesce(x["alias"], F.lit("")))), ",")
    return _rows(t, "Import").select(_base(), "source", F.col("default_alias").alias("def"), F.col("namespace_alias").alias("ns"), names.alias("names"))


@example(_values("file, name, first, last, exported, asynchronous, params, returns", ("people.ts", "makePerson", 6, 8, True, False, "name,age", "Person"), ("people.ts", "nextId", 10, 12, False, False, "", "string"), ("store.ts", "add", 8, 16, True, False, "name", "Person"), ("store.ts", "check", 18, 20, True, False, "p", "boolean"), ("store.ts", "missing", 22, 24, True, True, "xs", None), ("index.ts", "load", 3, 3, True, True, "id", None), ("View.tsx", "helper", 8, 8, True, False, "", None), ("Row.tsx", "Row", 1, 3, True, False, "props", None)))
def ts_functions(t: Tables):
    f = _rows(t, "Function").where("name <> 'View'")
    return f.select(_base(), "name", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("is_exported").alias("exported"), F.col("is_async").alias("asynchronous"), F.array_join(F.transform("params", lambda x: x["name"]), ",").alias("params"), F.col("return_type").alias("returns"))


@example(_values("name, complexity, cognitive, nesting", ("makePerson", 1, 0, 0), ("nextId", 1, 0, 0), ("add", 5, 6, 2), ("check", 1, 0, 1), ("missing", 1, 0, 0), ("load", 1, 0, 0), ("helper", 1, 0, 0), ("Row", 1, 0, 0)))
def ts_complexity(t: Tables):
    f = _rows(t, "Function").where("name <> 'View'")
    return f.select("name", "complexity", F.col("cognitive_complexity").alias("cognitive"), F.col("nesting_depth").alias("nesting"))


@example(_values("name, first, last, abstract, parent, interfaces", ("Store", 5, 25, True, "Base", "Saver,Person"), ("Base", 1, 1, False, None, "")))
def ts_classes(t: Tables):
    return _rows(t, "Class").select("name", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("is_abstract").alias("abstract"), F.col("extends").alias("parent"), F.array_join(F.coalesce("implements", F.array().cast("array<string>")), ",").alias("interfaces"))


@example(_values("file, name, line, exported", ("store.ts", "p", 9, False), ("store.ts", "store", 27, True)))
def ts_variables(t: Tables):
    return _rows(t, "Variable", "%store.ts").select(_base(), "name", "line", F.col("is_exported").alias("exported"))


@example(_values("label, name, first", ("Interface", "Person", 2), ("Interface", "Saver", 2), ("Type", "Mode", 28), ("Type", "Kind", 29)))
def ts_types(t: Tables):
    pick = lambda k: _rows(t, k).select(F.lit(k).alias("label"), "name", F.col("start_line").alias("first"))
    return pick("Interface").unionAll(pick("Type"))


@example(_values("name, props_type, props", ("View", "ViewProps", "title!,size?"), ("Row", "RowProps", "")))
def ts_components(t: Tables):
    props = F.array_join(F.transform(F.coalesce("props", F.array().cast(dict(_rows(t, "Component").dtypes)["props"])), lambda x: F.concat(x["name"], F.when(x["required"], "!").otherwise("?"))), ",")
    return _rows(t, "Component").select("name", "props_type", props.alias("props"))


def _edges(t: Tables, *labels: str) -> DataFrame:
    return P.snapshot(t.spark).graph.edges.where(F.col("label").isin(*labels)).select("label", _short("src").alias("src"), _short("dst").alias("dst"))


CALLS = [
    ("CALLS", "Function:User.cs:Name", "Function:User.cs:Find"), ("CALLS", "Function:store.ts:add", "Function:store.ts:check"), ("CALLS", "Function:store.ts:add", "Function:people.ts:makePerson"),
    ("CALLS", "Function:store.ts:add", "Function:store.ts:missing"), ("CALLS", "Function:people.ts:makePerson", "Function:people.ts:nextId"), ("CALLS", "Function:app.py:run", "Function:util.py:helper"),
]
IMPORTS = [
    ("IMPORTS", "File:User.cs", "File:external:System"), ("IMPORTS", "File:app.py", "File:util.py"), ("IMPORTS", "File:View.tsx", "File:Row.tsx"), ("IMPORTS", "File:store.ts", "File:index.ts"), ("IMPORTS", "File:store.ts", "File:people.ts"),
]


@example(_values("label, src, dst", *CALLS))
def index_calls(t: Tables):
    return _edges(t, "CALLS")


@example(_values("label, src, dst", *IMPORTS))
def index_imports(t: Tables):
    return _edges(t, "IMPORTS")


@example(_values("label, src, dst", ("RENDERS", "Component:View.tsx:View", "Component:Row.tsx:Row")))
def index_renders(t: Tables):
    return _edges(t, "RENDERS")


@example(
    _values(
        "label, src, dst", ("EXTENDS", "Class:store.ts:Store", "Class:index.ts:Base"), ("EXTENDS", "Class:app.py:Job", "Class:external:Base"), ("EXTENDS", "Class:User.cs:User", "Class:external:Entity"),
        ("IMPLEMENTS", "Class:store.ts:Store", "Interface:external:Saver"), ("IMPLEMENTS", "Class:store.ts:Store", "Interface:people.ts:Person"), ("IMPLEMENTS", "Class:User.cs:User", "Interface:external:IUser"),
    )
)
def index_inheritance(t: Tables):
    return _edges(t, "EXTENDS", "IMPLEMENTS")


@example(_values("path, failed", ("/demo/py/bad.py", True)))
def parse_errors(t: Tables):
    return P.snapshot(t.spark).errors().select("path", F.col("error").isNotNull().alias("failed"))


@example(_values("kind, name, n", ("Class", "Job", 6), ("Function", "helper", 1), ("Function", "run", 7), ("Import", ".util", 2), ("Variable", "LIMIT", 3)))
def py_entities(t: Tables):
    pick = lambda k, name, n: _rows(t, k, "%.py").select(F.lit(k).alias("kind"), F.col(name).alias("name"), F.col(n).alias("n"))
    return pick("Class", "name", "start_line").unionAll(pick("Function", "name", "start_line")).unionAll(pick("Import", "source", "line")).unionAll(pick("Variable", "name", "line"))


@example(_values("source, resolved", (".util", "/demo/py/util.py")))
def py_imports(t: Tables):
    i = _rows(t, "Import", "%.py").drop("resolved_path").withColumn("module", F.col("source"))
    return R.resolve_python_imports(i, P.snapshot(t.spark).files, P.ROOT).select("source", F.col("resolved_path").alias("resolved"))


@example(_values("kind, name, n", ("Class", "User", 3), ("Function", "Find", 7), ("Function", "Name", 6), ("Function", "User", 5), ("Import", "System", 1), ("Variable", "x", 4)))
def cs_entities(t: Tables):
    pick = lambda k, name, n: _rows(t, k, "%.cs").select(F.lit(k).alias("kind"), F.col(name).alias("name"), F.col(n).alias("n"))
    return pick("Class", "name", "start_line").unionAll(pick("Function", "name", "start_line")).unionAll(pick("Import", "source", "line")).unionAll(pick("Variable", "name", "line"))


def _guide(t: Tables) -> DataFrame:
    return extract(P.files(t.spark, {"docs/guide.md": P.GUIDE}))


@example(_values("title, heading, first, last, parent", ("Guide", "One", 4, 11, None), ("Guide", "Two", 6, 10, "One"), ("Guide", "Three", 10, 10, "Two"), ("Guide", "Four", 11, 11, "One"), ("Guide", "Five", 12, 13, None)))
def md_sections(t: Tables):
    x = _guide(t)
    docs = rows_of(x, "MarkdownDocument")
    s = section_spans(rows_of(x, "Section"), docs)
    names = s.select(F.col("id").alias("parent_id"), F.col("heading").alias("parent"))
    return s.join(names, "parent_id", "left").join(docs.select("file_path", "title"), "file_path").select("title", "heading", F.col("start_line").alias("first"), F.col("end_line").alias("last"), "parent")


@example(_values("language, content, target", ("ts", "code", "./b.md#top")))
def md_blocks_and_links(t: Tables):
    x = _guide(t)
    return rows_of(x, "CodeBlock").join(rows_of(x, "Link"), "file_path").select("language", "content", "target")


# rules -------------------------------------------------------------------------------------------------------------
def _rule(rule: str, cases: list[tuple[str, int]]) -> None:
    def run(t: Tables):
        x = P.ruled(t.spark)
        every = t.spark.createDataFrame([(f"{P.ROOT}/{rule}/{k}.ts", k) for k in range(len(cases))], "file string, code int")
        hits = rows_of(x, "Finding").where(F.col("type") == rule).select("file", "type")
        return every.join(hits, "file", "left").groupBy("code").agg(F.count("type").cast("int").alias("n"))

    run.__name__ = f"rule_{rule}"
    example(_values("code, n", *[(k, n) for k, (_, n) in enumerate(cases)]))(run)


for _name, _cases in P.RULES.items():
    _rule(_name, _cases)


@example(_values("kind, category, what", ("source", "user_input", "id"), ("source", "user_input", "e"), ("sink", "xss", "id"), ("sink", "command_injection", "(e)")))
def taint_points(t: Tables):
    x, own = P.ruled(t.spark), F.col("file").endswith("flows/0.ts")
    src = rows_of(x, "Source").where(own).select(F.lit("source").alias("kind"), "category", F.col("variable").alias("what"))
    return src.unionAll(rows_of(x, "Sink").where(own).select(F.lit("sink").alias("kind"), "category", F.col("argument").alias("what")))


@example(_values("type, severity, steps, sanitizers", ("sql_injection", "critical", "source:3 sink:3", "")))
def flow_path_build(t: Tables):
    p = Service(t.spark, P.snapshot(t.spark)).flow_paths()
    steps = F.array_join(F.transform("steps", lambda x: F.concat(x["kind"], F.lit(":"), x["line"].cast("string"))), " ")
    return p.select("type", "severity", steps.alias("steps"), F.array_join("sanitizers", ",").alias("sanitizers"))


@example(_values("unvalidated_payment_amount, pci_data_logging, hardcoded_payment_key, missing_idempotency_key", (1, 1, 1, 1)))
def payment_findings(t: Tables):
    return A.payment_summary(rows_of(P.ruled(t.spark), "Finding")).select(*[F.col(c).cast("int").alias(c) for c in A.PAYMENT_RULES])


@example(_values("argument, names", ("escape(a) + sanitize(b)", "escape,sanitize"), ("a", "")))
def sanitizers_by_name(t: Tables):
    from ..functions.rules import sanitizers_in

    return t.spark.createDataFrame([("escape(a) + sanitize(b)",), ("a",)], "argument string").select("argument", F.array_join(sanitizers_in(F.col("argument")), ",").alias("names"))


# indexing and events -----------------------------------------------------------------------------------------------
CHANGED = {"src/people.ts": "export function makePerson() { return other(); }\nexport function other() {}\n", "src/new.ts": "import { makePerson } from './people';\nexport function fresh() { makePerson(); }\n"}


def _after(*, without: str = "util.py") -> list[tuple]:
    kept = [x for x in CALLS + IMPORTS if without not in x[1] and without not in x[2] and "nextId" not in x[2]]
    return [*kept, ("CALLS", "Function:people.ts:makePerson", "Function:people.ts:other"), ("CALLS", "Function:new.ts:fresh", "Function:people.ts:makePerson"), ("IMPORTS", "File:new.ts", "File:people.ts")]


@example(_values("label, src, dst", *_after()))
def foreach_upsert(t: Tables):
    """Edges after events: a file changed, one came, one was removed; files that didn't change keep what they refer to."""
    from ..streaming.apply import SnapshotStore, apply_events

    store = SnapshotStore(t.spark, scratch.new_path(t.spark, "store"), P.ROOT, "demo")
    store.write(P.snapshot(t.spark), 0)
    events = t.spark.createDataFrame([(f"{P.ROOT}/src/people.ts", "change"), (f"{P.ROOT}/src/new.ts", "add"), (f"{P.ROOT}/py/util.py", "unlink")], "path string, type string")
    apply_events(store, events, P.files(t.spark, CHANGED), 1)
    e = store.read().graph.edges.where("label in ('CALLS', 'IMPORTS')")
    return e.select("label", _short("src").alias("src"), _short("dst").alias("dst"))


@example(_values("missing, added", (0, 0)))
def reindex_equals_index(t: Tables):
    """Edges and nodes that the two ways to the same files don't share."""
    old = P.snapshot(t.spark)
    gone = t.spark.createDataFrame([(f"{P.ROOT}/py/util.py",)], "path string")
    a = reindex(old, P.files(t.spark, CHANGED), gone).graph
    b = link(*_whole(t), P.ROOT, "demo").graph
    rows = lambda g: g.nodes.select("id", "label").unionAll(g.edges.select(F.concat_ws(">", "src", "dst"), "label"))
    n = lambda x, y: rows(x).exceptAll(rows(y)).agg(F.count("*").cast("int")).scalar()
    return t.spark.range(1).select(n(b, a).alias("missing"), n(a, b).alias("added"))


def _whole(t: Tables) -> tuple[DataFrame, DataFrame]:
    every = P.files(t.spark, {k: v for k, v in (P.FILES | CHANGED).items() if k != "py/util.py"})
    return scratch.materialize(S.file_rows(every), "files"), extract(every)


@example(_values("kind, n", ("Function", 14), ("Class", 4), ("Component", 2), ("Error", 1)))
def project_extract_counts(t: Tables):
    x = P.snapshot(t.spark).extracted
    return x.where("kind in ('Function', 'Class', 'Component', 'Error')").groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@example(_values("name, file, exported", ("makePerson", "people.ts", True), ("nextId", "people.ts", False), ("helper", "View.tsx", True)))
def symbol_lookups(t: Tables):
    """All of a file, and of a name those that are exported from one file."""
    f = P.snapshot(t.spark).table("Function")
    both = R.lookup(f, file=f"{P.ROOT}/src/people.ts").unionAll(R.lookup(f, name="helper", file=f"{P.ROOT}/src/View.tsx", exported=True))
    return both.select("name", _base(), F.col("is_exported").alias("exported"))

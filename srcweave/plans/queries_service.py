"""The service's operations, events as a stream, samples and caches; expected rows are stated by hand or in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..functions import nlp, values as V
from ..operators.ingest import parse_file
from ..service import Projects, Service, interval_of
from ..streaming import cache
from . import sample_project as P, scratch
from .queries_extract import _short, _values
from .roster import example, query
from .testgraph import Tables


def _service(t: Tables) -> Service:
    s = Service(t.spark, P.snapshot(t.spark))
    s.contents = P.files(t.spark)
    s.projects.add("demo", P.ROOT)
    return s


@example(_values("name, label", ("Store", "Class"), ("store", "Variable"), ("store.ts", "File")))
def rest_search(t: Tables):
    return _service(t).search("STORE").where("label <> 'Function' and name like '%tore%'").select("name", "label")


@example(_values("name", ("add",)))
def tool_search_code(t: Tables):
    """By name with case, and as a pattern: what both find."""
    s = _service(t)
    return s.search_code("add").join(s.search_code("^add$", "pattern").select("id"), "id", "left_semi").select("name")


@example(_values("name, file", ("helper", "View.tsx"), ("helper", "util.py")))
def tool_find_symbol(t: Tables):
    return _service(t).find_symbol("helper", "Function").select("name", F.element_at(F.split("file_path", "/"), -1).alias("file"))


@example(_values("direction, type, other", ("out", "CONTAINS", "Component:View.tsx:View"), ("out", "CONTAINS", "Function:View.tsx:View"), ("out", "CONTAINS", "Function:View.tsx:helper"), ("out", "CONTAINS", "Variable:View.tsx:View"), ("out", "IMPORTS", "File:Row.tsx")))
def tool_get_context(t: Tables):
    around = _service(t).get_context(f"File:{P.ROOT}/src/View.tsx")[1].where("type <> 'HAS_FILE'")
    return around.select("direction", "type", _short("other").alias("other"))


@example(_values("part, id", ("dependencies", "File:index.ts"), ("dependencies", "File:people.ts"), ("average", "2.3333")))
def tool_explain_code(t: Tables):
    x = _service(t).explain_code(f"{P.ROOT}/src/store.ts")
    pick = lambda k: x[k].select(F.lit(k).alias("part"), _short("id").alias("id"))
    return pick("dependencies").unionAll(pick("dependents")).unionAll(x["complexity"].select(F.lit("average"), F.format_string("%.4f", "average")))


@example(_values("direct, transitive, files, tests, score, tier", (1, 1, 2, 0, "12.5", "medium")))
def tool_analyze_impact(t: Tables):
    i = _service(t).impact("nextId")
    whole = [F.col(c).cast("int").alias(c) for c in ("direct", "transitive", "files", "tests")]
    return i.select(*whole, F.format_string("%.1f", F.col("score").cast("double")).alias("score"), "tier")


@example(_values("type, severity, file", ("sql_injection", "critical", "index.ts")))
def tool_find_vulnerabilities(t: Tables):
    return _service(t).security(least="high", category="sql").select("type", "severity", F.element_at(F.split("file", "/"), -1).alias("file"))


@example(_values("what, name, depth", ("callers", "add", 2), ("callers", "makePerson", 1), ("deps", "check", 1), ("deps", "makePerson", 1), ("deps", "missing", 1), ("deps", "nextId", 2)))
def command_analyze(t: Tables):
    s = _service(t)
    names = s.graph.nodes.select("id", "name")
    pick = lambda what, x: s.analyze(what, x).join(names, "id").select(F.lit(what).alias("what"), "name", F.col("depth").cast("int").alias("depth"))
    return pick("callers", "nextId").unionAll(pick("deps", "add"))


@example(_values("name, complexity", ("add", 5), ("Name", 3), ("run", 4)))
def tool_complexity_report(t: Tables):
    return _service(t).complexity(3)[0].select("name", F.col("complexity").cast("int").alias("complexity"))


@example(_values("number, line", (1, "import React from 'react';"), (2, "import { Row } from './Row';")))
def rest_source(t: Tables):
    return _service(t).source(f"{P.ROOT}/src/View.tsx", 1, 2).select(F.col("number").cast("int").alias("number"), "line")


@example(_values("step, names", (0, "other"), (1, ""), (2, "other,third")))
def configure_projects(t: Tables):
    """Active projects after setting one, removing it, and adding two; by name in any case or by the path's end."""
    p = Projects()
    for name, root in (("demo", "/demo"), ("Other", "/work/other"), ("third", "/work/x3")):
        p.add(name, root)
    rows = [",".join(p.configure(a, n)["active"]).lower() for a, n in (("set", ("other",)), ("remove", ("OTHER",)), ("add", ("other", "x3")))]
    return t.spark.createDataFrame(list(enumerate(rows)), "step int, names string")


@example(_values("files, left_over", (8, 0)))
def rest_delete_and_clear(t: Tables):
    """Files after one was deleted, and nodes after the graph was cleared."""
    s = _service(t)
    s.delete_file(f"{P.ROOT}/py/util.py")
    files = s.graph.nodes.where("label = 'File' and not is_external").count()
    s.clear()
    return t.spark.createDataFrame([(files, s.graph.nodes.count() + s.graph.edges.count())], "files int, left_over int")


@example(_values("kind, name", ("Class", "Job"), ("Function", "run"), ("Import", ".util"), ("Variable", "LIMIT"), ("error", "/x.unknown")))
def live_parse_of_a_file(t: Tables):
    got = parse_file(f"{P.ROOT}/py/app.py", P.FILES["py/app.py"])
    rows = [(k, r.get("name") or r["source"]) for k in ("Class", "Function", "Import", "Variable") for r in got[k]]
    try:
        parse_file("/x.unknown", "")
    except ValueError:
        rows.append(("error", "/x.unknown"))
    return t.spark.createDataFrame(rows, "kind string, name string")


@example(_values("milliseconds", (300000,), (7200000,), (3600000,), (86400000,)))
def schedules(t: Tables):
    return t.spark.createDataFrame([(interval_of(x),) for x in ("*/5 * * * *", "0 */2 * * *", "0 * * * *", "30 4 * * *")], "milliseconds int")


@example(_values("code, shell", ("npm install x", True), ("$ ls", True), ("# note", True), ("let a = 1", False)))
def shell_blocks(t: Tables):
    c = t.spark.createDataFrame([("npm install x",), ("$ ls",), ("# note",), ("let a = 1",)], "code string")
    return c.select("code", V.is_shell(F.lit("ts"), F.col("code")).alias("shell"))


# samples and caches ------------------------------------------------------------------------------------------------
@query("WITH x AS (SELECT conv_id || '-' || turn AS id, text, string_split(text, ' ')[2] AS w FROM conversations) SELECT id, w AS entity, instr(text, w) - 1 AS start, instr(text, w) - 1 + length(w) AS \"end\" FROM x WHERE w IS NOT NULL AND w <> ''")
def annotate_batches(t: Tables):
    """Entities that a model names, ten texts at a time: here a stand-in that names every second word."""

    def second(texts: list[str]) -> list[list[dict]]:
        return [[{"text": w[1], "type": "Person"}, {"text": "nowhere at all", "type": "Person"}] if len(w) > 1 and w[1] else [] for w in (x.split(" ") for x in texts)]

    rows = t.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text").where("text is not null")
    got = nlp.annotate(rows, second)
    return got.select(F.col("sample_id").alias("id"), F.col("text").alias("entity"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND ts + CASE event_type WHEN 'view' THEN INTERVAL 300 SECOND WHEN 'click' THEN INTERVAL 3600 SECOND ELSE INTERVAL 600 SECOND END > (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def cache_get_and_invalidate(t: Tables):
    e = t.table("events")
    seconds = F.when(F.col("event_type") == "view", 300).when(F.col("event_type") == "click", 3600).otherwise(600)
    entries = e.select("event_id", F.col("event_type").alias("type"), F.col("ts").alias("created"), seconds.alias("ttl"))
    now = e.agg(F.max("ts") - F.expr("interval 2 day")).first()[0]
    return cache.live(cache.invalidate(entries, "error"), now).select("event_id", F.col("type").alias("event_type"))


# a stream ----------------------------------------------------------------------------------------------------------
@example(_values("type, path", ("file-changed", "/src/people.ts"), ("file-removed", "/py/util.py"), ("graph-updated", None)))
def stream_file_events(t: Tables):
    """Messages of a stream of file events: debounced, ignored paths left out, applied, and handed to a sink."""
    from ..streaming.apply import EVENT, SnapshotStore, read_events, run

    base = scratch.new_path(t.spark, "stream")
    store = SnapshotStore(t.spark, f"{base}/store", P.ROOT, "demo")
    store.write(P.snapshot(t.spark), 0)
    rows = [("src/people.ts", "add", "00:00.000"), ("src/people.ts", "change", "00:00.200"), ("py/util.py", "unlink", "00:00.100"), ("node_modules/x.ts", "add", "00:00.100"), ("late.ts", "add", "09:00.000")]
    text = "\n".join(json.dumps({"path": f"{P.ROOT}/{p}", "type": k, "ts": f"2024-01-01T00:{at}Z"}) for p, k, at in rows)
    scratch.write_text(t.spark, f"{base}/events/1.json", text)

    def sink(messages: DataFrame, _: int) -> None:
        messages.select("type", "path").write.mode("append").parquet(f"{base}/messages")

    for _ in range(2):  # the second start finds the watermark beyond the first run of events
        q = run(read_events(t.spark, f"{base}/events"), store, lambda _: P.files(t.spark), f"{base}/checkpoint", (sink,), available_now=True)
        q.awaitTermination()
        scratch.write_text(t.spark, f"{base}/events/2.json", text.split("\n")[-1].replace("00:09", "00:10"))
    got = t.spark.read.schema(EVENT.rsplit(",", 1)[0]).parquet(f"{base}/messages")
    return got.where("path is null or path not like '%late%'").select("type", F.replace("path", F.lit(P.ROOT), F.lit("")).alias("path")).distinct()

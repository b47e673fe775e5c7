"""From files to a graph: extraction, resolution joins and snapshots, as one plan over all files.

Extraction is a per-file function in Python workers: a file's text is parsed once and gives rows of every kind, packed
as JSON; a file that doesn't parse gives one row with its error and the job goes on. What follows are DataFrame joins.

A snapshot keeps what was extracted, so when some files change only these are parsed again (``reindex``). Names are then
resolved over all that is kept, as a new symbol or file may answer to references in files that didn't change: the
result is that of a full index. Where a name stands for several components, all of them are rendered.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EDGE_SCHEMA, PARAMS, PROPS, SCHEMAS, SPECIFIERS, node_id
from ..plans import scratch
from ..sources.files import CSHARP, PYTHON, TYPESCRIPT, file_rows
from . import resolve as R
from .graph import PropertyGraph

CALL = "file_path string, caller string, caller_line int, callee string, line int"
RENDER = "file_path string, parent string, child string, line int"
FINDING = "type string, severity string, file string, line int, column int, code string, description string, fix string"
SOURCE = "file string, category string, pattern string, variable string, line int, column int"
SINK = "file string, category string, severity string, pattern string, argument string, line int, column int"
ROWS = SCHEMAS | {"Call": CALL, "Render": RENDER, "Finding": FINDING, "Source": SOURCE, "Sink": SINK}
ROWS |= {
    "MarkdownDocument": "id string, file_path string, title string, frontmatter map<string,string>, lines int",
    "Section": "id string, file_path string, heading string, level int, start_line int",
    "CodeBlock": "id string, file_path string, language string, content string, start_line int, end_line int",
    "Link": "id string, file_path string, text string, target string, line int",
}
Extractor = Callable[[str, str], dict[str, list[dict]]]


class Registry:
    """Extractors by file ending; users add their own."""

    def __init__(self) -> None:
        self._by_ending: dict[str, tuple[str, Extractor]] = {}

    def register(self, name: str, endings: tuple[str, ...], extractor: Extractor) -> None:
        for e in endings:
            self._by_ending[e.lower()] = (name, extractor)

    def for_path(self, path: str) -> Extractor | None:
        found = self._by_ending.get("." + path.rsplit(".", 1)[-1].lower()) if "." in path else None
        return found[1] if found else None

    def supported(self, path: str) -> bool:
        return self.for_path(path) is not None

    def list(self) -> list[str]:
        return sorted({n for n, _ in self._by_ending.values()})

    def endings(self) -> list[str]:
        return sorted(self._by_ending)

    def clear(self) -> None:
        self._by_ending.clear()


def _module(m) -> dict[str, list[dict]]:
    return {"Function": m.functions, "Class": m.classes, "Interface": m.interfaces, "Variable": m.variables, "Type": m.types, "Component": m.components, "Import": m.imports, "Call": m.calls, "Render": m.renders}


def _typescript(path: str, code: str) -> dict[str, list[dict]]:
    from ..functions import security
    from ..functions.typescript import Module

    sources, sinks = security.flow_points(path, code)
    return _module(Module(path, code)) | {"Finding": security.findings(path, code), "Source": sources, "Sink": sinks}


def _python(path: str, code: str) -> dict[str, list[dict]]:
    from ..functions.python_source import Module

    return _module(Module(path, code))


def _csharp(path: str, code: str) -> dict[str, list[dict]]:
    from ..functions.csharp import Module

    return _module(Module(path, code))


def _markdown(path: str, text: str) -> dict[str, list[dict]]:
    from ..functions.markdown import Document

    d = Document(path, text)
    return {"MarkdownDocument": [d.document], "Section": d.sections, "CodeBlock": d.code_blocks, "Link": d.links}


def default_registry() -> Registry:
    r = Registry()
    r.register("typescript", TYPESCRIPT, _typescript)
    r.register("python", PYTHON, _python)
    r.register("csharp", CSHARP, _csharp)
    r.register("markdown", (".md", ".mdx"), _markdown)
    return r


def extract(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(path, kind, row: JSON, error) of all files, written once by kind."""
    registry = registry or default_registry()

    def run(it):
        import pandas as pd

        for pdf in it:
            out = []
            for path, code in zip(pdf["path"], pdf["content"], strict=True):
                fn = registry.for_path(path)
                if fn is None:
                    out.append((path, "Error", None, "no extractor for this ending"))
                    continue
                try:
                    out += [(path, kind, json.dumps(r), None) for kind, rows in fn(path, code or "").items() for r in rows]
                except Exception as e:  # a file that can't be parsed is a row, not a failed job
                    out.append((path, "Error", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "kind", "row", "error"])

    return scratch.materialize(files.select("path", "content").mapInPandas(run, "path string, kind string, row string, error string"), "extracted", ("kind",))


def rows_of(extracted: DataFrame, kind: str) -> DataFrame:
    return extracted.where(F.col("kind") == kind).select(F.from_json("row", ROWS[kind]).alias("r")).select("r.*")


@dataclass
class Snapshot:
    """Typed tables of one index run, and the graph."""

    files: DataFrame
    extracted: DataFrame
    graph: PropertyGraph
    root: str = ""
    project: str | None = None
    duration_ms: int = 0

    def save(self, path: str) -> None:
        self.files.write.mode("overwrite").parquet(f"{path}/files")
        self.extracted.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/extracted")
        self.graph.save(path)

    @staticmethod
    def load(spark: SparkSession, path: str, root: str = "", project: str | None = None) -> Snapshot:
        x = spark.read.schema("path string, row string, error string, kind string").parquet(f"{path}/extracted").select("path", "kind", "row", "error")
        return Snapshot(spark.read.parquet(f"{path}/files"), x, PropertyGraph.load(spark, path), root, project)

    def table(self, kind: str) -> DataFrame:
        return self.files if kind == "File" else rows_of(self.extracted, kind)

    def errors(self) -> DataFrame:
        return self.extracted.where("kind = 'Error'").select("path", "error")

    def stats(self) -> DataFrame:
        kinds = ("Function", "Class", "Interface", "Variable", "Type", "Component", "Import")
        e = self.extracted.agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds], F.count_if(F.col("kind").isin(*[k for k in kinds if k != "Import"])).alias("entities"), F.count_if(F.col("kind") == "Error").alias("errors"))
        return e.select(self.files.agg(F.count("*")).scalar().alias("files"), "*", self.graph.edges.agg(F.count("*")).scalar().alias("edges"), F.lit(self.duration_ms).cast("long").alias("duration_ms"))


def imported_names(imports: DataFrame) -> DataFrame:
    """(file_path, local, source_name, resolved_path) for every name that an import brings in."""
    named = imports.select("file_path", "resolved_path", F.explode("specifiers").alias("x"))
    named = named.select("file_path", F.coalesce("x.alias", "x.name").alias("local"), F.col("x.name").alias("source_name"), "resolved_path")
    plain = imports.where("default_alias is not null").select("file_path", F.col("default_alias").alias("local"), F.col("default_alias").alias("source_name"), "resolved_path")
    return named.unionAll(plain)


def index(files: DataFrame, root: str = "", registry: Registry | None = None, project: str | None = None) -> Snapshot:
    """Index files (path, content, modified): all entities and edges."""
    began = time.monotonic()
    out = link(scratch.materialize(file_rows(files), "files"), extract(files, registry), root, project)
    return replace(out, duration_ms=round(1000 * (time.monotonic() - began)))


def reindex(old: Snapshot, files: DataFrame, removed: DataFrame, registry: Registry | None = None) -> Snapshot:
    """The snapshot after some files (path, content, modified) came or changed and others (path) were removed."""
    began = time.monotonic()
    fr, x = scratch.materialize(file_rows(files), "files"), extract(files, registry)
    gone = scratch.materialize(removed.select("path").unionAll(fr.select("path")).distinct(), "gone")
    fr = scratch.materialize(old.files.join(gone, "path", "left_anti").unionByName(fr), "files")
    x = scratch.materialize(old.extracted.join(gone, "path", "left_anti").unionByName(x), "extracted", ("kind",))
    return replace(link(fr, x, old.root, old.project), duration_ms=round(1000 * (time.monotonic() - began)))


def parse_file(path: str, content: str, registry: Registry | None = None) -> dict[str, list[dict]]:
    """One file's rows by kind, parsed here and now; an ending without an extractor is an error."""
    fn = (registry or default_registry()).for_path(path)
    if fn is None:
        raise ValueError(f"no extractor for {path}")
    return fn(path, content)


def link(fr: DataFrame, x: DataFrame, root: str = "", project: str | None = None) -> Snapshot:
    """The graph of files and what was extracted from them."""
    spark: SparkSession = fr.sparkSession
    t = {k: rows_of(x, k) for k in ("Function", "Class", "Interface", "Variable", "Type", "Component", "Import", "Call", "Render")}
    paths = fr.select("path")
    imports = t["Import"].drop("resolved_path")
    is_python = F.col("file_path").rlike(r"\.(py|pyw|pyi)$")
    scripts = R.resolve_imports(imports.where(~is_python & ~F.col("file_path").endswith(".cs")), paths)
    pythons = R.resolve_python_imports(imports.where(is_python).withColumn("module", F.col("source")), paths, root).drop("module")
    usings = imports.where(F.col("file_path").endswith(".cs")).withColumn("resolved_path", F.concat(F.lit("external:"), "source"))
    imports = scratch.materialize(scripts.unionByName(pythons).unionByName(usings), "imports")
    names = imported_names(imports)

    nodes = fr.select(node_id("File", F.col("path")).alias("id"), F.lit("File").alias("label"), "name", "path", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("long").alias("start_line"), F.lit(False).alias("is_external"))
    for label in ("Function", "Class", "Interface", "Variable", "Type", "Component"):
        line = F.col("line" if label == "Variable" else "start_line").cast("long")
        e = t[label].select(node_id(label, F.col("file_path"), F.col("name"), line).alias("id"), F.lit(label).alias("label"), "name", F.lit(None).cast("string").alias("path"), "file_path", line.alias("start_line"), F.lit(False).alias("is_external"))
        nodes = nodes.unionByName(e.dropDuplicates(["id"]))
    nodes = scratch.materialize(nodes, "nodes")
    fid = lambda c: F.concat(F.lit("File:"), c)
    none = [F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("count")]
    contains = nodes.where("file_path is not null").select(fid(F.col("file_path")).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("label"), *none)
    to = imports.where("resolved_path is not null").select("file_path", F.col("resolved_path").alias("to")).distinct()
    edges = contains.unionByName(to.select(fid(F.col("file_path")).alias("src"), fid(F.col("to")).alias("dst"), F.lit("IMPORTS").alias("label"), *none))

    fn = nodes.where("label = 'Function'")
    calls = R.resolve_names(t["Call"].withColumnRenamed("callee", "name"), fn, names).where("to_file is not null")
    src = fn.select(F.col("id").alias("src"), F.col("file_path"), F.col("name").alias("caller"), F.col("start_line").alias("caller_line"))
    dst = fn.select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), F.col("name").alias("to_name"))
    calls = calls.join(src, ["file_path", "caller", "caller_line"]).join(dst, ["to_file", "to_name"])
    edges = edges.unionByName(calls.groupBy("src", "dst").agg(F.min("line").alias("line"), F.count("*").alias("count")).withColumn("label", F.lit("CALLS")))

    comp = nodes.where("label = 'Component'")
    renders = R.resolve_names(t["Render"].withColumnRenamed("child", "name"), comp, names)
    renders = renders.where("to_name is not null").join(comp.select(F.col("id").alias("src"), "file_path", F.col("name").alias("parent")), ["file_path", "parent"])
    renders = renders.join(comp.select(F.col("id").alias("dst"), F.col("name").alias("to_name")), "to_name").where("src <> dst")
    edges = edges.unionByName(renders.groupBy("src", "dst").agg(F.min("line").alias("line")).withColumns({"label": F.lit("RENDERS"), "count": F.lit(None).cast("long")}))

    cls = t["Class"].select(F.lit("Class").alias("own"), "file_path", F.col("name").alias("child"), "start_line", F.col("extends").alias("one"), F.col("implements").alias("many"))
    iface = t["Interface"].select(F.lit("Interface").alias("own"), "file_path", F.col("name").alias("child"), "start_line", F.lit(None).cast("string").alias("one"), F.col("extends").alias("many"))
    up = cls.where("one is not null").select("own", "file_path", "child", "start_line", F.col("one").alias("name"), F.lit("EXTENDS").alias("label"), F.lit("Class").alias("want"))
    up = up.unionByName(cls.select("own", "file_path", "child", "start_line", F.explode("many").alias("name"), F.lit("IMPLEMENTS").alias("label"), F.lit("Interface").alias("want")))
    up = up.unionByName(iface.select("own", "file_path", "child", "start_line", F.explode("many").alias("name"), F.lit("EXTENDS").alias("label"), F.lit("Interface").alias("want")))
    kinds = nodes.where("label in ('Class', 'Interface')")
    up = R.resolve_names(up, kinds, names).withColumns({"to_file": F.coalesce("to_file", F.lit("external")), "to_name": F.coalesce("to_name", "name")})
    found = kinds.select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), F.col("name").alias("to_name"))
    up = up.join(found, ["to_file", "to_name"], "left").withColumn("dst", F.coalesce("dst", node_id(F.col("want"), F.col("to_file"), F.col("to_name"))))
    up = scratch.materialize(up.withColumn("src", node_id(F.col("own"), F.col("file_path"), F.col("child"), F.col("start_line"))), "inherits")
    edges = edges.unionByName(up.select("src", "dst", "label", *none).dropDuplicates(["src", "dst", "label"]))

    # stubs: only for targets that nothing in the whole snapshot answers to
    outside = up.select(F.col("dst").alias("id"), F.col("want").alias("label"), F.col("to_name").alias("name"), F.lit(None).cast("string").alias("path"), F.col("to_file").alias("file_path"))
    outside = outside.unionByName(to.select(fid(F.col("to")).alias("id"), F.lit("File").alias("label"), F.element_at(F.split("to", "/"), -1).alias("name"), F.col("to").alias("path"), F.lit(None).cast("string").alias("file_path")))
    stubs = outside.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").withColumns({"start_line": F.lit(None).cast("long"), "is_external": F.lit(True)})
    nodes = nodes.unionByName(stubs)
    if project:
        nodes = nodes.unionByName(spark.createDataFrame([(f"Project:{project}", "Project", project)], "id string, label string, name string"), allowMissingColumns=True)
        edges = edges.unionByName(fr.select(F.lit(f"Project:{project}").alias("src"), fid(F.col("path")).alias("dst"), F.lit("HAS_FILE").alias("label"), *none))
    edges = edges.select(*[c.split()[0] for c in EDGE_SCHEMA.split(", ")])
    graph = PropertyGraph(scratch.materialize(nodes, "graph_nodes", ("label",)), scratch.materialize(edges, "graph_edges", ("label",)))
    return Snapshot(fr, x, graph, root, project)


__all__ = ["PARAMS", "PROPS", "SPECIFIERS", "Registry", "Snapshot", "default_registry", "extract", "index", "link", "parse_file", "reindex", "rows_of"]

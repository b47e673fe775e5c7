"""The service's operations: what the REST routes, the tools and the commands do, as methods that return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import rules, values as V
from .operators import analysis as A, changes as C, graph as G, paths as P, resolve as R, upsert as U
from .operators.ingest import Snapshot, index, reindex
from .plans import scratch
from .plans.cypher import cypher
from .sources import files as S
from .streaming.cache import ResultCache
from .streaming.debounce import ANALYSIS_MS


class Projects:
    """Registered projects, which of them are active, and paths by name."""

    def __init__(self) -> None:
        self.all: dict[str, str] = {}
        self.active: set[str] = set()

    def add(self, name: str, root: str) -> None:
        self.all[name] = root.rstrip("/")

    def resolve(self, name: str) -> str | None:
        """A project by name, by name in any case, or by the end of its path."""
        if name in self.all:
            return self.all[name]
        low = {k.lower(): v for k, v in self.all.items()}
        return low.get(name.lower()) or next((v for v in self.all.values() if v.endswith("/" + name)), None)

    def _names(self, names) -> set[str]:
        roots = {self.resolve(n) for n in names} - {None}
        return {k for k, v in self.all.items() if v in roots}

    def configure(self, action: str, names: tuple[str, ...] = ()) -> dict:
        if action == "set":
            self.active = self._names(names)
        elif action == "add":
            self.active |= self._names(names)
        elif action == "remove":
            self.active -= self._names(names)
        elif action not in ("list", "status"):
            raise ValueError(action)
        return {"projects": sorted(self.all), "active": sorted(self.active)}

    def prefixes(self) -> list[str]:
        return [self.all[n] + "/" for n in sorted(self.active)]


class Service:
    """One index and everything that is asked of it."""

    def __init__(self, spark: SparkSession, snapshot: Snapshot, commits: DataFrame | None = None, modified: DataFrame | None = None):
        self.spark, self.snapshot, self.graph = spark, snapshot, snapshot.graph
        self.commits, self.modified, self.projects, self.cache = commits, modified, Projects(), ResultCache(spark)

    @staticmethod
    def parse_project(spark: SparkSession, root: str, name: str | None = None) -> Service:
        out = Service(spark, index(S.scan(spark, root), root.rstrip("/"), project=name))
        out.contents = S.scan(spark, root)
        if name:
            out.projects.add(name, root)
        return out

    contents: DataFrame | None = None

    # graph routes -------------------------------------------------------------------------------------------------
    def functions(self) -> DataFrame:
        ids = self.graph.nodes.where("label = 'Function'").select("id", "name", "file_path", F.col("start_line").cast("int").alias("start_line"))
        return ids.join(self.snapshot.table("Function").drop("docstring"), ["name", "file_path", "start_line"])

    def calls(self) -> DataFrame:
        return self.graph.edges.where("label = 'CALLS'")

    def full_graph(self, limit: int = 100_000, prefix: str | None = None) -> G.PropertyGraph:
        return self.graph.full(limit, prefix)

    def file_graph(self, path: str) -> G.PropertyGraph:
        return self.graph.file_subgraph(f"File:{path}")

    def entity(self, ref: str) -> tuple[DataFrame, DataFrame]:
        e = self.graph.entity(ref)
        return e, self.graph.connections(e)

    def neighbors(self, ref: str, direction: str = "both", types: tuple[str, ...] = (), depth: int = 1) -> DataFrame:
        return self.graph.neighbors(self.graph.center(ref), direction, types, depth, depth * 50)

    def nodes(self, page: int = 1, limit: int = 50, labels: tuple[str, ...] = (), project: str | None = None, query: str | None = None) -> tuple[DataFrame, DataFrame]:
        root = self.projects.resolve(project) if project else None
        return self.graph.page(page, limit, labels, root, query)

    def search(self, term: str, labels: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
        return self.graph.search(term, labels, self.projects.prefixes(), limit=limit)

    def stats(self) -> dict[str, DataFrame]:
        contains = self.graph.edges.where("label = 'CONTAINS'")
        return {"nodes": A.node_stats(self.graph.nodes), "edges": A.edge_stats(self.graph.edges), "largest": A.largest_files(contains), "connected": A.most_connected(self.graph.nodes, self.graph.edges)}

    def source(self, path: str, first: int = 1, last: int = 1_000_000_000) -> DataFrame:
        return V.source_slice(self.contents, path, first, last)

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        return cypher(self.graph, text, params)

    def parse_file(self, path: str, content: str) -> None:
        """Index one file anew, or for the first time."""
        self._changed([(path, content, None)], [])

    def delete_file(self, path: str) -> None:
        self._changed([], [path])

    def _changed(self, rows: list[tuple], removed: list[str]) -> None:
        files = self.spark.createDataFrame(rows, "path string, content string, modified timestamp")
        self.snapshot = reindex(self.snapshot, files, self.spark.createDataFrame([(p,) for p in removed], "path string"))
        self.graph = self.snapshot.graph
        self.cache.invalidate()
        if self.contents is not None:
            gone = [p for p, *_ in rows] + removed
            self.contents = self.contents.where(~F.col("path").isin(*gone)).unionByName(files)

    def trigger_reindex(self) -> DataFrame:
        """Parse what has changed since the index was made (by its contents' hashes); returns the changes."""
        now = S.file_rows(self.contents).select("path", "hash")
        changes = scratch.materialize(C.detect_changes(self.snapshot.files.select("path", "hash"), now).where("type <> 'unchanged'"), "changes")
        came = changes.where("type <> 'deleted'").select("path")
        self.snapshot = reindex(self.snapshot, self.contents.join(came, "path", "left_semi"), changes.where("type = 'deleted'").select("path"))
        self.graph = self.snapshot.graph
        self.cache.invalidate()
        return changes

    def delete_project(self, name: str) -> None:
        self.graph = U.delete_project(self.graph, f"Project:{name}")

    def clear(self) -> None:
        self.graph = U.clear(self.graph)

    # analytics ----------------------------------------------------------------------------------------------------
    def security(self, severity: str | None = None, least: str | None = None, category: str | None = None, unique: bool = False) -> DataFrame:
        """Findings by severity; an exact severity, a least one, or a part of the type."""
        f = self.snapshot.table("Finding")
        if severity:
            f = f.where(F.col("severity") == severity)
        if least:
            f = f.where(A.severity_rank(F.col("severity")) >= A.SEVERITIES[least])
        if category:
            f = f.where(F.lower("type").contains(category.lower()))
        if unique:
            f = f.dropDuplicates(["file", "line", "type"])
        return f.orderBy(A.severity_rank(F.col("severity")).desc(), "file", "line", "column", "type")

    def security_summary(self) -> DataFrame:
        return A.severity_summary(self.snapshot.table("Finding"))

    def payment_summary(self) -> DataFrame:
        return A.payment_summary(self.snapshot.table("Finding"))

    def complexity(self, threshold: int = 10, by: str = "complexity", scope: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        f = self.functions()
        f = f.where(F.col("file_path").startswith(scope)) if scope else f
        return A.hotspots(f, threshold, strict=False, by=by, limit=limit), A.complexity_summary(f, threshold)

    def dataflow(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(taint sources, sinks, flows that no sanitiser breaks)."""
        src, dst = self.snapshot.table("Source"), self.snapshot.table("Sink")
        a = src.select("file", F.col("category").alias("source"), "variable", F.col("line").alias("source_line"))
        b = dst.select("file", F.col("category").alias("type"), "severity", F.col("pattern").alias("sink"), "argument", F.col("line").alias("sink_line"))
        return src, dst, R.taint_matches(a, b, rules.SANITIZERS)

    def flow_paths(self) -> DataFrame:
        """Every source that meets a sink, as two steps, with the sanitisers named on the way."""
        src, dst, _ = self.dataflow()
        a = src.select("file", "variable", F.struct(F.col("line"), F.col("variable").alias("code"), F.lit("source").alias("kind")).alias("x"))
        b = dst.select("file", "argument", "severity", F.col("category").alias("type"), F.struct(F.col("line"), F.col("pattern").alias("code"), F.lit("sink").alias("kind")).alias("y"))
        return R.taint_matches(a, b).select("file", "type", "severity", F.array("x", "y").alias("steps"), rules.sanitizers_in(F.col("argument")).alias("sanitizers"))

    def impact(self, symbol: str, file: str | None = None, depth: int = 5) -> DataFrame:
        """One row: direct and transitive callers, tests, files, score and tier of changing a symbol."""
        target = self.graph.nodes.where((F.col("name") == symbol) & (F.col("label") == "Function"))
        target = target.where(F.col("file_path") == file) if file else target
        target = target.select("id")
        who = A.callers(self.calls(), target, depth).join(self.graph.nodes.select("id", "file_path"), "id")
        every = A.callers(self.calls(), target, None).join(self.graph.nodes.select("id", "file_path"), "id")
        tests = every.agg(F.count_if(A.is_test_path(F.col("file_path")) | A.is_test_name(F.col("file_path"))).alias("t"))
        top = self.functions().join(target, "id", "left_semi").agg(F.max("complexity").alias("c"))
        n = who.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.count_distinct("file_path").alias("files"))
        score = A.impact_score(F.col("direct"), F.col("transitive"), F.col("tests") > 0, F.col("complexity"))
        out = n.withColumn("tests", tests.scalar()).withColumn("complexity", top.scalar())
        return out.withColumn("score", score).withColumn("tier", A.impact_tier(F.col("score")))

    def refactoring(self, file: str, threshold: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(coupling by function, summary, responsibilities) of a file."""
        f = self.functions().where(F.col("file_path") == file)
        reads = self.graph.edges.where("label = 'READS'")
        c = A.coupling(f, self.calls(), reads, threshold)
        return c.orderBy("score", "id"), A.coupling_summary(c), A.responsibilities(f, self.calls()).orderBy(F.desc("size"), "component")

    def run(self, kind: str, **parameters):
        """An analysis by name (security, complexity, refactoring, dataflow, impact, summary), from the cache while it lives."""
        return self.cache.of(kind, lambda: getattr(self, kind)(**parameters), **parameters)

    def summary(self) -> DataFrame:
        s = A.severity_summary(self.snapshot.table("Finding")).select(F.col("total").alias("findings"), "critical", "high")
        c = A.complexity_summary(self.functions())
        return s.select("*", *[c.select(x).scalar().alias(x) for x in c.columns])

    # tools --------------------------------------------------------------------------------------------------------
    def ping(self) -> dict:
        return {"status": "ok"}

    def configure_projects(self, action: str, names: tuple[str, ...] = ()) -> dict:
        return self.projects.configure(action, names)

    def index_status(self) -> DataFrame:
        return self.snapshot.stats()

    def index_line(self) -> DataFrame:
        return A.index_line(self.graph.nodes)

    def find_symbol(self, name: str, kind: str | None = None, file: str | None = None, limit: int = 10) -> DataFrame:
        return G.find_symbol(self.graph, name, kind, file, limit)

    def search_code(self, term: str, kind: str = "name", scope: str | None = None, limit: int = 50) -> DataFrame:
        """By name with case, else in any case; ``pattern`` takes the term as a regular expression."""
        if kind == "pattern":
            return self.graph.scan(prefix=scope).where(F.col("name").rlike(term)).orderBy("name", "id").limit(limit)
        return self.graph.search(term, (), (scope,) if scope else (), case=kind == "name", limit=limit, paths=kind != "name")

    def get_context(self, ref: str) -> tuple[DataFrame, DataFrame]:
        """A file with what it contains and its relations, or a symbol with its callers and up to 20 callees."""
        e = self.graph.entity(ref)
        around = self.graph.connections(e).where("type <> 'CONTAINS' or direction = 'out'")
        w = A.Window.partitionBy("type", "direction").orderBy("other")
        return e, around.withColumn("n", F.row_number().over(w)).where("not (type = 'CALLS' and direction = 'out' and n > 20)").drop("n")

    def explain_code(self, file: str, first: int = 1, last: int = 1_000_000_000) -> dict[str, DataFrame]:
        """The code, files that it imports, that import it (20 each), tests that reach it (10), and its complexity."""
        start = self.graph.nodes.where(F.col("id") == f"File:{file}").select("id")
        hop = lambda d: self.graph.expand(start, ["IMPORTS"], d).select(F.col("other").alias("id")).distinct().orderBy("id").limit(20)
        inside = self.graph.expand(start, ["CONTAINS"]).select(F.col("other").alias("id"))
        tests = P.reach(self.calls(), inside, "in").join(self.graph.nodes.select("id", "file_path"), "id").where(A.is_test_path(F.col("file_path"))).select("file_path").distinct().orderBy("file_path").limit(10)
        return {"code": self.source(file, first, last), "dependencies": hop("out"), "dependents": hop("in"), "tests": tests, "complexity": self.functions().where(F.col("file_path") == file).agg(F.avg("complexity").alias("average"))}

    def repo_map(self, shown: int = 5) -> DataFrame:
        return A.repo_map(self.snapshot.files, shown)

    def directories(self, depth: int = 3) -> DataFrame:
        return A.directory_rollup(self.snapshot.files, depth).orderBy(F.desc("files"), "dir")

    def symbol_history(self, name: str, now: str) -> DataFrame:
        """History of the files that define a symbol."""
        if self.modified is None:
            raise ValueError("no commits were synced")
        files = self.graph.nodes.where((F.col("name") == name) & F.col("file_path").isNotNull()).select(F.concat(F.lit("File:"), "file_path").alias("src")).distinct()
        c = self.commits.select(F.concat(F.lit("Commit:"), "hash").alias("dst"), "author", F.to_timestamp("date").alias("date"))
        rows = self.modified.join(files, "src", "left_semi").join(c, "dst").select(F.col("src").alias("file_id"), "author", "date")
        return A.symbol_history(rows, now)

    def analyze(self, what: str, symbol: str, depth: int = 3) -> DataFrame:
        """The command: ``callers`` or ``deps`` of a symbol."""
        start = self.graph.nodes.where(F.col("name") == symbol).select("id")
        if what == "callers":
            return A.callers(self.calls(), start, depth).orderBy("depth", "id")
        return P.reach(self.calls(), start, "out", min(depth, 10)).where("depth > 0").select("id", "depth").orderBy("depth", "id")


def debounce_ms() -> int:
    """Quiet time after the last change before analyses run again."""
    return ANALYSIS_MS


def interval_of(cron: str) -> int:
    """Milliseconds between runs of a schedule: ``*/n`` minutes or hours, a fixed minute as hourly, a fixed hour as daily."""
    minute, hour, *_ = cron.split()
    if minute.startswith("*/"):
        return int(minute[2:]) * 60_000
    if hour.startswith("*/"):
        return int(hour[2:]) * 3_600_000
    return 3_600_000 if hour == "*" else 86_400_000


def severity_at_least(c: Column, least: str) -> Column:
    return A.severity_rank(c) >= A.SEVERITIES[least]

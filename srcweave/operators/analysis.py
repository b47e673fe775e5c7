"""Analyses over the graph: complexity, impact, coupling, statistics, directories, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import EDGE_LABELS, NODE_LABELS
from ..plans import scratch
from .components import connected_components
from .paths import reach

#: Severities with their ranks.
SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def severity_rank(c: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in SEVERITIES.items():
        out = out.when(c == k, v)
    return out.otherwise(-1)


#: A tier begins above these cyclomatic and cognitive complexities.
COMPLEXITY_TIERS = (("critical", 50, None), ("high", 20, 30), ("medium", 10, 15))
#: A risk begins above this number of callers.
RISK_COUNTS = (("critical", 20), ("high", 10), ("medium", 5))
#: Weights of the impact score, the complexity above which its last one counts, and where each tier ends.
DIRECT, TRANSITIVE, UNTESTED, COMPLEX, COMPLEX_ABOVE = 2, 0.5, 10, 5, 20
IMPACT_TIERS = (("low", 5), ("medium", 15), ("high", 30))
#: The patterns by which a path is a test's.
TEST_PATHS = (r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"__tests__/", r"/tests?/", r"\.tests?\.[jt]sx?$")


def _first_of(cases: list[tuple[Column, str]], other: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for test, name in cases:
        out = out.when(test, name)
    return out.otherwise(other)


def complexity_tier(cyclomatic: Column, cognitive: Column) -> Column:
    return _first_of([((cyclomatic > a) if b is None else (cyclomatic > a) | (cognitive > b), name) for name, a, b in COMPLEXITY_TIERS], "low")


def risk_by_count(transitive: Column) -> Column:
    return _first_of([(transitive > n, name) for name, n in RISK_COUNTS], "low")


def impact_score(direct: Column, transitive: Column, has_tests: Column, complexity: Column) -> Column:
    return DIRECT * direct + TRANSITIVE * transitive + F.when(has_tests, 0).otherwise(UNTESTED) + F.when(F.coalesce(complexity, F.lit(0)) > COMPLEX_ABOVE, COMPLEX).otherwise(0)


def impact_tier(score: Column) -> Column:
    return _first_of([(score <= n, name) for name, n in IMPACT_TIERS], "critical")


def is_test_path(path: Column) -> Column:
    return path.rlike("|".join(TEST_PATHS))


def is_test_name(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.")


def hotspots(functions: DataFrame, threshold: int = 5, strict: bool = True, by: str = "complexity", limit: int = 50) -> DataFrame:
    """The most complex functions; the service takes those above 5 and end - start lines, the tool 10 or more and one line more."""
    over = F.col("complexity") > threshold if strict else F.col("complexity") >= threshold
    lines = F.col("end_line") - F.col("start_line") + (0 if strict else 1)
    return functions.where(F.col("complexity").isNotNull() & over).withColumn("lines", lines).orderBy(F.desc(by), "id").limit(limit)


def complexity_summary(functions: DataFrame, threshold: int = 10) -> DataFrame:
    return functions.agg(
        F.count("*").alias("functions"), F.max("complexity").alias("max_complexity"), F.round(F.avg("complexity"), 1).alias("avg_complexity"), F.count_if(F.col("complexity") >= threshold).alias("over_threshold")
    )


def zero_filled(counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(label, n) for every known label, unknown ones left out."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(x,) for x in labels], "label string")
    return dim.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def node_stats(nodes: DataFrame) -> DataFrame:
    return zero_filled(nodes.groupBy("label").agg(F.count("*").alias("n")), NODE_LABELS)


def edge_stats(edges: DataFrame) -> DataFrame:
    return zero_filled(edges.groupBy("label").agg(F.count("*").alias("n")), EDGE_LABELS)


def largest_files(contains: DataFrame, limit: int = 10) -> DataFrame:
    return contains.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("entities")).orderBy(F.desc("entities"), "id").limit(limit)


def most_connected(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("Function", "Class", "Component"), limit: int = 10) -> DataFrame:
    """Nodes by undirected degree; a self-loop counts once. Ends are counted before any join."""
    ends = edges.select("src", "dst").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    picked = nodes.where(F.col("label").isin(*labels)).select("id", "name", "label")
    return degree.join(picked, "id").orderBy(F.desc("degree"), "id").limit(limit)


def internal_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, internal_calls): calls of each function into its own file, 0 without any."""
    files = functions.select("id", "file_path")
    same = calls.join(files.toDF("src", "a"), "src").join(files.toDF("dst", "b"), "dst").where("a = b").groupBy("src").agg(F.countDistinct("dst").alias("n"))
    return functions.join(same, functions["id"] == same["src"], "left").select("id", F.coalesce("n", F.lit(0)).alias("internal_calls"))


def coupling(functions: DataFrame, calls: DataFrame, reads: DataFrame, threshold: int = 3) -> DataFrame:
    """(id, internal_calls, state_reads, score, candidate): two aggregates joined, never the product of both."""
    calls_in = internal_calls(functions, calls)
    states = reads.groupBy("src").agg(F.countDistinct("dst").alias("s"))
    out = calls_in.join(states, calls_in["id"] == states["src"], "left")
    score = F.col("internal_calls") + F.coalesce("s", F.lit(0))
    return out.select("id", "internal_calls", F.coalesce("s", F.lit(0)).alias("state_reads"), score.alias("score"), (score < threshold).alias("candidate"))


def coupling_summary(scores: DataFrame) -> DataFrame:
    avg = F.avg("score")
    level = F.when(avg <= 3, "low").when(avg <= 6, "medium").otherwise("high")
    return scores.agg(F.round(avg, 1).alias("avg_score"), F.max("score").alias("max_score"), F.count_if("candidate").alias("candidates"), level.alias("level"))


def needs_refactoring(functions: Column, average: Column) -> Column:
    """A file with more than 15 functions, or with an average coupling above medium."""
    return (functions > 15) | (average > 6)


def responsibilities(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, component, size): groups of a file's functions that call each other, in either direction."""
    files = functions.select("id", "file_path")
    inner = calls.join(files.toDF("src", "a"), "src").join(files.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
    groups = connected_components(inner)
    out = files.join(groups, "id", "left").select("id", "file_path", F.coalesce("component", "id").alias("component"))
    return out.groupBy("file_path", "component").agg(F.count("*").alias("size"))


def callers(edges: DataFrame, targets: DataFrame, depth: int | None = 5) -> DataFrame:
    """(id, depth): who reaches the targets over CALLS, with the least number of hops; the targets themselves left out."""
    return reach(edges, targets, "in", depth).where("depth > 0").join(targets.select("id"), "id", "left_anti").select("id", "depth")


def directory_rollup(files: DataFrame, depth: int = 3) -> DataFrame:
    """(dir, depth, files): recursive number of files below each directory of up to ``depth`` levels."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    level = files.select(F.explode(F.when(F.size(dirs) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(dirs), F.lit(depth))), lambda k: F.struct(F.array_join(F.slice(dirs, F.lit(1), k), "/").alias("dir"), k.alias("depth"))))).alias("x"))
    return level.groupBy("x.dir", "x.depth").agg(F.count("*").alias("files"))


def _first_and_all(rows: DataFrame, keys: list[str], name: str, shown: int) -> DataFrame:
    """(keys, total, x: the first names in order). Ranks are limited before the shuffle and totals counted map-side, so a
    key with very many rows sends few of them."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(name))).where(F.col("_n") <= shown)
    return total.join(first.groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias("x")), keys)


def repo_map(files: DataFrame, shown: int = 5) -> DataFrame:
    """(dir, files, listing): up to five names of each directory and how many more there are."""
    d = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))
    out = _first_and_all(d, ["dir"], "name", shown).withColumnRenamed("total", "files")
    more = F.when(F.col("files") > shown, F.concat(F.lit(" ... "), (F.col("files") - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return out.select("dir", "files", F.concat(F.array_join("x", ", "), more).alias("listing"))


def symbol_history(modified: DataFrame, now: str) -> DataFrame:
    """(file_id, commits, authors, age_days, per_month) of rows (file_id, author, date); now as a parameter."""
    age = F.floor((F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.min("date"))) / 86400)
    out = modified.groupBy("file_id").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), age.alias("age_days"), F.max("date").alias("last"))
    return out.withColumn("per_month", F.when(F.col("age_days") > 0, F.round(F.col("commits") / F.col("age_days") * 30, 1)).otherwise(F.col("commits").cast("double")))


#: The rules on payments.
PAYMENT_RULES = ("unvalidated_payment_amount", "pci_data_logging", "hardcoded_payment_key", "missing_idempotency_key")


def payment_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("type") == k).alias(k) for k in PAYMENT_RULES])


def index_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, functions, classes, interfaces, components, edges."""
    n = nodes.agg(*[F.count_if((F.col("label") == x) & ~F.coalesce("is_external", F.lit(False))).alias(y) for x, y in INDEXED.items()])
    return n.withColumn("edges", edges.agg(F.count("*")).scalar())


SLICES = 8  # parts of a node's connections in relation_groups
INDEXED = {"File": "files", "Function": "functions", "Class": "classes", "Interface": "interfaces", "Component": "components"}


def index_line(nodes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("label") == x) for x in INDEXED]
    return nodes.agg(F.format_string("%d files, %d functions, %d classes, %d interfaces, %d components", *counts).alias("line"))


def parse_totals(contains: DataFrame) -> DataFrame:
    """(files, entities, edges) of CONTAINS: files that hold something, and what they hold."""
    per = contains.groupBy("src").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


def flow_summary(flows: DataFrame) -> DataFrame:
    """(file_path, flows, tainted, open: tainted and not sanitised) of rows (file_path, tainted, sanitized)."""
    return flows.groupBy("file_path").agg(F.count("*").alias("flows"), F.count_if("tainted").alias("tainted"), F.count_if(F.col("tainted") & ~F.col("sanitized")).alias("open"))


def distinct_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, names in order, each once, joined by commas)."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"))


def contained(entities: DataFrame, shown: int = 8) -> DataFrame:
    """(file_path, position, name): the first entities of each file by line and then name."""
    w = Window.partitionBy("file_path").orderBy("start_line", "name")
    return entities.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= shown).select("file_path", "position", "name")


def severity_summary(findings: DataFrame) -> DataFrame:
    names = [k for k in SEVERITIES if k != "info"]
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == k).alias(k) for k in names])


def relation_groups(connections: DataFrame, shown: int = 5) -> DataFrame:
    """Distinct connections of each node by (type, direction): up to five names and the number of all.

    A group is dealt to ``SLICES`` tasks by names, so that a hub isn't one task's; each sends its number and its first names.
    Rows are made distinct by their order there, so they are shuffled once."""
    keys, tasks = ["id", "type", "direction"], scratch.parts(connections.sparkSession)
    rows = connections.select(*keys, "other").withColumn("_slice", F.pmod(F.xxhash64("other"), F.lit(SLICES)).cast("int"))
    w = Window.partitionBy(*keys, "_slice").orderBy(F.asc_nulls_last("other"))
    rows = rows.repartition(tasks, *keys, "_slice").withColumns({"_n": F.dense_rank().over(w)})
    part = rows.groupBy(*keys, "_slice").agg(F.max("_n").alias("n"), F.collect_set(F.when(F.col("_n") <= shown, F.col("other"))).alias("x"))
    out = part.groupBy(*keys).agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, shown).alias("x"))
    return out.select(*keys, "total", F.array_join("x", ",").alias("shown"))

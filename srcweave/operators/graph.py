"""Property-graph operators: scans, expands, neighbourhoods, search and paging.

A graph is a pair of DataFrames: nodes(id, label, name, path, file_path, start_line, ...) and edges(src, dst, label,
line, count). Stored by ``save`` both are partitioned by label, so a label or type predicate prunes partitions and the
rest of a filter reaches the scan. Every operator returns a lazy DataFrame and orders before it limits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    words: DataFrame | None = None  # stored inverted index of the names

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        return PropertyGraph(*[spark.read.parquet(f"{path}/{x}") for x in ("nodes", "edges", "words")])

    def save(self, path: str) -> None:
        for name, df in (("nodes", self.nodes), ("edges", self.edges)):
            df.write.mode("overwrite").partitionBy("label").parquet(f"{path}/{name}")
        in_order(word_index(self.nodes)).write.mode("overwrite").parquet(f"{path}/words")

    # scans ------------------------------------------------------------------------------------------------------
    def scan(self, *labels: str, prefix: str | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
        """Nodes with one of the labels (all without any), below one of the path prefixes."""
        out = self.nodes.where(F.col("label").isin(*labels)) if labels else self.nodes
        roots = [p for p in (prefix, *prefixes) if p]
        return out.where(any_prefix(place(), roots)) if roots else out

    def scan_edges(self, types: Sequence[str] = (), src_labels: Sequence[str] = (), dst_labels: Sequence[str] = ()) -> DataFrame:
        out = self.edges.where(F.col("label").isin(*types)) if types else self.edges
        for side, labels in (("src", src_labels), ("dst", dst_labels)):
            if labels:
                ends = self.nodes.where(F.col("label").isin(*labels)).select(F.col("id").alias(side))
                out = out.join(ends, side, "left_semi")
        return out

    # expands ----------------------------------------------------------------------------------------------------
    def expand(self, start: DataFrame, types: Sequence[str] = (), direction: str = "out", optional: bool = False, key: str = "id") -> DataFrame:
        """One hop: the rows of ``start`` with (edge_type, edge_src, edge_dst, other: the node reached).

        direction ``both`` takes an edge in either direction, a self-loop once. optional keeps rows without an edge.
        """
        e = self.edges.where(F.col("label").isin(*types)) if types else self.edges
        cols = [F.col("label").alias("edge_type"), F.col("src").alias("edge_src"), F.col("dst").alias("edge_dst"), F.col("line").alias("edge_line")]
        out = e.select(F.col("src").alias("_from"), F.col("dst").alias("other"), *cols)
        into = e.select(F.col("dst").alias("_from"), F.col("src").alias("other"), *cols)
        hops = {"out": out, "in": into}.get(direction)
        if hops is None:
            hops = out.unionAll(into.where("edge_src <> edge_dst"))
        return start.join(hops, start[key] == hops["_from"], "left" if optional else "inner").drop("_from")

    def neighbors(self, center: DataFrame, direction: str = "both", types: Sequence[str] = (), depth: int = 1, limit: int | None = None) -> DataFrame:
        """Nodes within ``depth`` hops of the centre's (id), with their least depth; the centre itself is left out."""
        from .paths import reach

        found = reach(self.edges if not types else self.edges.where(F.col("label").isin(*types)), center.select("id"), direction, depth).where("depth > 0")
        near = found.groupBy("id").agg(F.min("depth").alias("depth")).join(center.select("id"), "id", "left_anti")
        out = self.nodes.join(near, "id")
        return out.orderBy("depth", "id").limit(limit) if limit else out

    def connections(self, entity: DataFrame) -> DataFrame:
        """Distinct (entity, direction, type, other) of the given nodes, in two expands rather than their product."""
        pick = lambda d: self.expand(entity.select("id"), direction=d).select("id", F.lit(d).alias("direction"), F.col("edge_type").alias("type"), "other")
        return pick("out").unionAll(pick("in")).distinct()

    def instantiations(self, name: str) -> DataFrame:
        """(id, class, line): who makes objects of the classes of this name."""
        classes = self.scan("Class").where(F.col("name") == name).select("id")
        return self.expand(classes, ["INSTANTIATES"], "in").select(F.col("other").alias("id"), F.col("id").alias("class"), F.col("edge_line").alias("line"))

    def exports(self, path: str) -> DataFrame:
        """(id, label, name) of what a file exports."""
        file = self.nodes.where((F.col("label") == "File") & (F.col("path") == path)).select("id")
        return self.nodes.join(self.expand(file, ["EXPORTS"]).select(F.col("other").alias("id")), "id").select("id", "label", "name")

    def file_subgraph(self, file_id: str) -> PropertyGraph:
        """A file, what it contains and every neighbour of that, with the edges between."""
        center = self.nodes.where(F.col("id") == file_id).select("id")
        inside = self.expand(center, ["CONTAINS"]).select(F.col("other").alias("id"))
        core = center.unionAll(inside).distinct()
        around = self.expand(inside, direction="both").select(F.col("other").alias("id"))
        ids = core.unionAll(around).distinct()
        edges = self.edges.join(core.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(self.edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        return PropertyGraph(self.nodes.join(ids, "id", "left_semi"), edges.dropDuplicates(["src", "dst", "label"]))

    def full(self, limit: int = 1000, prefix: str | None = None) -> PropertyGraph:
        """The first nodes by id and the edges between them; external nodes that these reach come along."""
        known = self.scan(prefix=prefix).where(~F.coalesce(F.col("is_external"), F.lit(False)))
        picked = known.orderBy("id").limit(limit)
        ids = picked.select("id")
        outside = self.nodes.where("is_external").join(self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        nodes = picked.unionByName(outside)
        return PropertyGraph(nodes, valid_edges(self.edges, nodes))

    # lookups ----------------------------------------------------------------------------------------------------
    def entity(self, ref: str) -> DataFrame:
        """A node by id, by path, or by ``name:file``: three keyed lookups rather than one disjunction."""
        hits = [self.nodes.where(F.col("id") == ref), self.nodes.where(F.col("path") == ref)]
        if ":" in ref:
            name, file = ref.split(":", 1)
            hits.append(self.nodes.where((F.col("name") == name) & (F.col("file_path") == file)))
        out = hits[0]
        for h in hits[1:]:
            out = out.unionByName(h)
        return out.dropDuplicates(["id"])

    def center(self, ref: str) -> DataFrame:
        """The nodes that a reference of any form means: ``File:path``, ``Label:file:name:line``, or what ``entity`` takes or
        a plain name."""
        parts = ref.split(":")
        if parts[0] == "File":
            return self.nodes.where((F.col("label") == "File") & (F.col("path") == ref.removeprefix("File:")))
        if len(parts) > 3 and parts[-1].isdigit():
            file, name, line = ":".join(parts[1:-2]), parts[-2], int(parts[-1])
            return self.nodes.where((F.col("label") == parts[0]) & (F.col("file_path") == file) & (F.col("name") == name) & (F.coalesce("start_line", F.lit(0)) == line))
        return self.entity(ref).unionByName(self.nodes.where(F.col("name") == ref)).dropDuplicates(["id"])

    def search(self, term: str, labels: Sequence[str] = (), prefixes: Sequence[str] = (), case: bool = False, limit: int | None = None, paths: bool = True) -> DataFrame:
        """Nodes whose name (or path) contains the term; filters come before the limit."""
        hit = lambda c: F.col(c).contains(term) if case else F.lower(c).contains(term.lower())
        where = hit("name") | (hit("path") | hit("file_path") if paths else F.lit(False))
        out = self.scan(*labels, prefixes=prefixes).where(F.coalesce(where, F.lit(False)))
        return out.orderBy("name", "id").limit(limit) if limit else out

    def page(self, page: int = 1, limit: int = 50, labels: Sequence[str] = (), prefix: str | None = None, query: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows of a page, one row of total, pages and has_more). page is 1 or more, limit at most 100."""
        page, limit = max(1, page), min(max(1, limit), 100)
        found = self.search(query, labels, (prefix,) if prefix else ()) if query else self.scan(*labels, prefix=prefix)
        rows = found.orderBy(sort_key(), "id").offset((page - 1) * limit).limit(limit)
        total = found.agg(F.count("*").alias("total"))
        pages = F.ceil(F.col("total") / limit).cast("int")
        return rows, total.select("total", pages.alias("total_pages"), (F.lit(page) < pages).alias("has_more"))

    def fulltext(self, term: str, limit: int | None = None) -> DataFrame:
        """(id, name, score): hits of the term's words among a name's words, from an inverted index of the names: the stored
        one, which is in order of words, so that other row groups are skipped, or one made on the way."""
        wanted = [w for w in _words_of(term) if w]
        index = word_index(self.nodes) if self.words is None else self.words
        out = index.where(F.col("word").isin(*wanted)).groupBy("id", "name").agg(F.count("*").alias("score"))
        return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def _words_of(text: str) -> list[str]:
    import re

    return re.split(r"\W+", text.lower())


def name_words(name: Column) -> Column:
    return F.array_remove(F.split(F.lower(name), r"\W+"), "")


def word_index(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", F.explode(name_words(F.col("name"))).alias("word"))


def in_order(words: DataFrame) -> DataFrame:
    return words.repartitionByRange("word").sortWithinPartitions("word")


def place() -> Column:
    """A node's path: its own for a file, else its file's."""
    return F.when(F.col("label") == "File", F.col("path")).otherwise(F.col("file_path"))


def in_projects(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with every project (project, root) whose root folder they lie below: an equi-join on a path's folders, of
    which there are as many as the path is deep, so any number of projects will do."""
    folders = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda k: F.array_join(F.slice("_p", 1, k), "/"))
    below = nodes.withColumn("_p", F.split(place(), "/")).where(F.size("_p") > 1).withColumn("root", F.explode(folders)).drop("_p")
    return below.join(roots.select("project", F.regexp_replace("root", "/$", "").alias("root")), "root")


def sort_key() -> Column:
    return F.when(F.col("label") == "File", F.col("path")).otherwise(F.col("name"))


def any_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return F.coalesce(out, F.lit(False))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def without_edges(nodes: DataFrame, edges: DataFrame, end: str = "dst") -> DataFrame:
    """Nodes at which none of the edges has that end (NOT EXISTS)."""
    return nodes.join(edges.select(F.col(end).alias("id")).distinct(), "id", "left_anti")


def accessors(edges: DataFrame, labels: Sequence[str] = ("READS", "WRITES")) -> DataFrame:
    """(id, label, n): how many edges of these labels lead to each node."""
    return edges.where(F.col("label").isin(*labels)).groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def focus(initial: DataFrame, expansions: DataFrame, edges: DataFrame) -> PropertyGraph:
    """A view on some nodes and what was expanded from them: nodes once (the first kept), edges with both ends."""
    both = initial.withColumn("_o", F.lit(0)).unionByName(expansions.withColumn("_o", F.lit(1)))
    nodes = first_by(both, ["id"], F.col("_o"), F.col("label")).drop("_o")
    return PropertyGraph(nodes, valid_edges(edges, nodes).dropDuplicates(["src", "dst", "label"]))


def find_symbol(graph: PropertyGraph, name: str, kind: str | None = None, file: str | None = None, limit: int = 10) -> DataFrame:
    """Nodes of exactly that name; rank 1 is the symbol, the others are alternatives."""
    from pyspark.sql import Window

    out = graph.scan(*([kind] if kind else [])).where((F.col("name") == name) & (F.col("label") != "File"))
    if file:
        out = out.where(F.col("file_path").contains(file))
    top = out.orderBy("file_path", "start_line", "id").limit(limit)  # at most ``limit`` rows are ranked on one task
    return top.withColumn("rank", F.row_number().over(Window.orderBy("file_path", "start_line", "id")))

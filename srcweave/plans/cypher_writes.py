"""Writing clauses of the query language, compiled to a set of changes against a snapshot.

A query reads with the clauses of ``cypher`` and ends in writes: ``SET``, ``MERGE`` of a node or of a relationship between
bound nodes with ``ON CREATE SET`` and ``ON MATCH SET``, ``DELETE`` of relationships and ``DETACH DELETE`` of nodes. All reads
are done and written (of the variables only those that the writes name) before the first write, so a query never sees its
own changes; where several rows set one property, the greatest value counts, and MERGE acts once for each node or pair
however many rows name it. The result is a ``Changes``: whole new rows and keys that go. As it holds values, not steps,
applying it twice changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..model import node_id
from ..operators.graph import PropertyGraph
from . import scratch
from .cypher import CypherError, _Query, _snake

EDGE_KEY = ("src", "dst", "label")


@dataclass
class Changes:
    """nodes, edges: new rows that replace those of their id or (src, dst, label); gone: ids, and such keys."""

    nodes: DataFrame
    edges: DataFrame
    gone_nodes: DataFrame
    gone_edges: DataFrame

    def apply(self, graph: PropertyGraph) -> PropertyGraph:
        """The next snapshot; edges of nodes that go, go too."""
        gone = self.gone_nodes.select("id")
        nodes = graph.nodes.join(self.nodes.select("id"), "id", "left_anti").unionByName(self.nodes).join(gone, "id", "left_anti")
        edges = graph.edges.join(self.edges.select(*EDGE_KEY), [*EDGE_KEY], "left_anti").unionByName(self.edges).join(self.gone_edges, [*EDGE_KEY], "left_anti")
        edges = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
        return PropertyGraph(nodes.select(*graph.nodes.columns), edges.select(*graph.edges.columns))


class _Write(_Query):
    def changes(self) -> Changes:
        none = lambda df: df.where(F.lit(False))
        self.nodes: list[DataFrame] = []
        self.edges: list[DataFrame] = []
        self.gone: list[DataFrame] = [none(self.g.nodes).select("id")]
        self.cut: list[DataFrame] = [none(self.g.edges).select(*EDGE_KEY)]
        while self.k < len(self.t) and self.peek() != ";":
            if self.take("OPTIONAL", "MATCH"):
                self.match(True)
            elif self.take("MATCH"):
                self.match(False)
            elif self.take("WITH"):
                self.project(False)
                if self.take("WHERE"):
                    self.rows = self.rows.where(self.expr())
            else:
                break
        if self.rows is None:
            self.rows = self.g.nodes.sparkSession.range(1).select(F.lit(1).alias("_one"))
        named = {x.strip("`") for _, x in self.t[self.k :]}
        self.rows = scratch.materialize(self.rows.select(F.lit(1).alias("_one"), *[F.col(f"`{v}`") for v in self.rows.columns if v in named]), "read")
        while self.k < len(self.t) and self.peek() != ";":
            if self.take("SET"):
                self._set()
            elif self.take("MERGE"):
                self._merge()
            elif self.take("DETACH", "DELETE"):
                self._delete(True)
            elif self.take("DELETE"):
                self._delete(False)
            else:
                raise CypherError(f"can't read {self.peek()!r} among writes")
        union = lambda found, like: self._last([none(like), *found], like)
        distinct = lambda found: self._all(found).distinct()
        return Changes(union(self.nodes, self.g.nodes), union(self.edges, self.g.edges), distinct(self.gone), distinct(self.cut))

    def _all(self, found: list[DataFrame]) -> DataFrame:
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def _last(self, found: list[DataFrame], like: DataFrame) -> DataFrame:
        """One row for each key: what a later clause wrote."""
        key = ["id"] if "id" in like.columns else [*EDGE_KEY]
        rows = self._all([x.select(*like.columns, F.lit(k).alias("_w")) for k, x in enumerate(found)])
        rest = [c for c in like.columns if c not in key]
        out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_w").alias("_x"))
        return out.select(*key, *[F.col("_x")[c].alias(c) for c in rest]).select(*like.columns)

    def _assignments(self) -> list[tuple[str, str, Column]]:
        """(variable, column, value) of ``v.key = expression, ...``"""
        out = []
        while not out or self.take(","):
            var = self.name()
            self.need(".")
            key = _snake(self.name())
            self.need("=")
            out.append((var, key, self.expr()))
        return out

    def _columns(self, kind: str) -> DataFrame:
        return self.g.nodes if kind == "node" else self.g.edges

    def _checked(self, kind: str, key: str) -> str:
        table = self._columns(kind)
        if key not in table.columns or key in ("id", *EDGE_KEY):
            raise CypherError(f"{key} can't be set")
        return dict(table.dtypes)[key]

    def _set(self) -> None:
        by: dict[str, list[tuple[str, Column]]] = {}
        for var, key, value in self._assignments():
            by.setdefault(var, []).append((key, value))
        for var, values in by.items():
            kind = self.kinds.get(var)
            if kind not in ("node", "rel"):
                raise CypherError(f"{var} is no node or relationship")
            table, key = self._columns(kind), ["id"] if kind == "node" else [*EDGE_KEY]
            rows = self.rows.where(F.col(var).isNotNull())
            rows = rows.select(*[F.col(var)[c].alias(c) for c in table.columns], *[v.cast(self._checked(kind, k)).alias(f"_v{i}") for i, (k, v) in enumerate(values)])
            set_ = {k: i for i, (k, _) in enumerate(values)}
            out = rows.groupBy(*key).agg(*[(F.max(f"_v{set_[c]}") if c in set_ else F.first(c)).alias(c) for c in table.columns if c not in key])
            (self.nodes if kind == "node" else self.edges).append(out.select(*table.columns))

    def _on(self) -> dict[str, list[tuple[str, str, Column]]]:
        out: dict[str, list[tuple[str, str, Column]]] = {"CREATE": [], "MATCH": []}
        while self.is_("ON"):
            self.need("ON")
            when = "CREATE" if self.take("CREATE") else "MATCH"
            if when == "MATCH":
                self.need("MATCH")
            self.need("SET")
            out[when] += self._assignments()
        return out

    def _merge(self) -> None:
        self.need("(")
        first = self.name() if self.t[self.k][0] == "name" else ""
        if first in self.kinds and self.take(")"):
            return self._merge_edge(first)
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = {_snake(k): v for k, v in self.map().items()} if self.peek() == "{" else {}
        self.need(")")
        label = labels[0] if labels else "File"
        if label == "File" and "path" in props:
            key = node_id("File", props["path"])
        elif {"name", "file_path"} <= set(props):
            key = node_id(label, props["file_path"], props["name"], props.get("start_line"))
        else:
            raise CypherError("MERGE of a node needs a path, or a name and a filePath")
        for c in props:
            if c not in self.node_columns:
                raise CypherError(f"{c} can't be set")
        kinds = dict(self.g.nodes.dtypes)
        made = self.rows.select(*self.rows.columns, key.alias("_id"), *[v.cast(kinds[c]).alias(f"_p_{c}") for c, v in props.items()]).where(F.col("_id").isNotNull())
        self._upsert("node", first or "_new", made.withColumn("_label", F.lit(label)), ["_id"], {c: F.col(f"_p_{c}") for c in props} | {"id": F.col("_id"), "label": F.col("_label")})

    def _merge_edge(self, src: str) -> None:
        back = self.take("<-")
        if not back:
            self.need("-")
        self.need("[")
        var = self.name() if self.t[self.k][0] == "name" else "_rel"
        self.need(":")
        label = self.name()
        self.need("]")
        self.need("-" if back else "->")
        self.need("(")
        dst = self.name()
        self.need(")")
        if dst not in self.kinds or self.kinds[dst] != "node" or self.kinds[src] != "node":
            raise CypherError("MERGE of a relationship needs two bound nodes")
        a, b = (dst, src) if back else (src, dst)
        made = self.rows.withColumns({"_src": F.col(a)["id"], "_dst": F.col(b)["id"], "_label": F.lit(label)}).where("_src is not null and _dst is not null")
        self._upsert("rel", var, made, ["_src", "_dst", "_label"], {"src": F.col("_src"), "dst": F.col("_dst"), "label": F.col("_label")})

    def _upsert(self, kind: str, var: str, made: DataFrame, key: list[str], new: dict[str, Column]) -> None:
        """Rows of nodes or edges after a MERGE: ON CREATE for keys that the snapshot hasn't, ON MATCH for the others."""
        table = self._columns(kind)
        there = table.select(*[F.col(c).alias(k) for c, k in zip(["id"] if kind == "node" else EDGE_KEY, key, strict=True)], F.struct(*table.columns).alias("_old"))
        types, rows = dict(table.dtypes), made.join(there, key, "left")
        fresh = F.struct(*[new.get(c, F.lit(None)).cast(types[c]).alias(c) for c in table.columns])
        rows = rows.withColumn(var, F.coalesce("_old", fresh))
        before, kinds = self.rows, dict(self.kinds)
        self.rows, self.kinds = rows, self.kinds | {var: kind}
        sets = self._on()
        for when in sets.values():
            for v, c, _ in when:
                if v != var:
                    raise CypherError(f"ON sets properties of {var} only")
                self._checked(kind, c)
        is_new = F.col("_old").isNull()
        value = lambda c: next((v.cast(types[c]) for _, k, v in reversed(sets["CREATE"]) if k == c), F.col(var)[c])
        other = lambda c: next((v.cast(types[c]) for _, k, v in reversed(sets["MATCH"]) if k == c), F.col(var)[c])
        changed = {k for when in sets.values() for _, k, _ in when}
        flat = rows.select(*key, *[(F.when(is_new, value(c)).otherwise(other(c)) if c in changed else F.col(var)[c]).alias(c) for c in table.columns])
        columns = [c for c in table.columns]
        out = flat.groupBy(*key).agg(*[(F.max(c) if c in changed else F.first(c)).alias(f"_o_{c}") for c in columns])
        (self.nodes if kind == "node" else self.edges).append(out.select(*[F.col(f"_o_{c}").alias(c) for c in columns]))
        self.rows, self.kinds = before, kinds

    def _delete(self, detach: bool) -> None:
        names: list[str] = []
        while not names or self.take(","):
            names.append(self.name())
        for var in names:
            kind = self.kinds.get(var)
            if kind == "node" and detach:
                self.gone.append(self.rows.where(F.col(var).isNotNull()).select(F.col(var)["id"].alias("id")))
            elif kind == "rel":
                self.cut.append(self.rows.where(F.col(var).isNotNull()).select(*[F.col(var)[c].alias(c) for c in EDGE_KEY]))
            else:
                raise CypherError(f"{var} can't be deleted" + ("; a node goes with DETACH DELETE" if kind == "node" else ""))


def changes(graph: PropertyGraph, text: str, params: dict | None = None) -> Changes:
    """What a writing query changes of a snapshot."""
    return _Write(graph, text, params or {}, None).changes()

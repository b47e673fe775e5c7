"""A subset of Cypher, compiled to DataFrames.

Clauses: MATCH, OPTIONAL MATCH, WHERE, WITH, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT, $parameters, and CALL of the
full-text index with YIELD. Patterns have labels, property maps, directed and undirected relationships, type lists and
lengths (``*``, ``*1..3``). A length without an end has none: paths grow until no edge is left that they don't hold, and
where the query returns distinct rows without the paths themselves, only their ends are sought. Grouping is
by the items that don't aggregate; within a MATCH no relationship is used twice; nulls sort as the largest values.
Parameters become literals of the plan, never text. Writing is refused here: ``cypher_writes`` makes changes of it.

A row holds a struct for each variable. Patterns are equi-joins on ids, so Catalyst picks how to join; where only the far
end of a pattern's first relationship is filtered, the nodes there are written and relationships meet these first. A pattern
that shares no variable with what is bound already would be a cross join and is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import PropertyGraph
from . import scratch

_TOKEN = re.compile(r"\s+|//[^\n]*|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<par>\$\w+)|(?P<op><=|>=|<>|=~|->|<-|\.\.|[-+*/%=<>()\[\]{},.:|])")
_WRITES = {"CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "FOREACH", "LOAD"}
_TESTS = {"NOT", "IS", "NULL", "STARTS", "ENDS", "WITH", "CONTAINS", "IN", "AND", "OR", "TRUE", "FALSE"}
_AGGREGATES: dict[str, Callable] = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "collect": F.collect_list,
}
_SCALARS: dict[str, Callable] = {
    "tolower": F.lower, "toupper": F.upper, "coalesce": F.coalesce, "size": F.size, "trim": F.trim, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round,
    "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "tofloat": lambda c: c.cast("double"), "split": lambda c, s: F.split(c, s),
    "substring": lambda c, a, n=None: F.substring(c, a + 1, n if n is not None else F.length(c)), "replace": F.replace, "head": lambda c: F.try_element_at(c, F.lit(1)), "last": lambda c: F.try_element_at(c, F.lit(-1)),
}


class CypherError(ValueError):
    pass


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def guard(text: str) -> None:
    """Refuse writing by keywords, not by text inside names or strings."""
    for m in _tokens(text):
        if m[0] == "name" and m[1].upper() in _WRITES:
            raise CypherError(f"{m[1]} is not allowed in a read-only query")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"can't read {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Query:
    def __init__(self, graph: PropertyGraph, text: str, params: dict, max_depth: int | None):
        self.g, self.params, self.max_depth = graph, params, max_depth
        self.t, self.k = _tokens(text), 0
        self.rows: DataFrame | None = None
        self.kinds: dict[str, str] = {}  # variable: node, rel, rels, path or value
        self.local: dict[str, tuple[Column, str]] = {}
        self.aggregated = False
        self.fresh = 0
        self.tests: dict[str, list[int]] = {}
        self.bare: str | None = None  # the node that a pattern begins at, while nothing filters it
        self.node_columns, self.edge_columns = set(graph.nodes.columns), set(graph.edges.columns)
        self.ends_only = self._distinct_ends()

    # tokens -----------------------------------------------------------------------------------------------------
    def peek(self, n: int = 0) -> str:
        return self.t[self.k + n][1] if self.k + n < len(self.t) else ""

    def is_(self, *words: str) -> bool:
        return all(self.peek(n).upper() == w for n, w in enumerate(words)) and (self.k >= len(self.t) or self.t[self.k][0] != "str")

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.k += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word} at {' '.join(x for _, x in self.t[self.k : self.k + 5])!r}")

    def name(self) -> str:
        kind, x = self.t[self.k] if self.k < len(self.t) else ("", "")
        if kind != "name":
            raise CypherError(f"expected a name at {x!r}")
        self.k += 1
        return x.strip("`")

    def _distinct_ends(self) -> bool:
        """Whether rows are made distinct at once, so that how many paths lead to an end makes no difference."""
        words = [x.upper() if k == "name" else x for k, x in self.t]
        clauses = [k for k, x in enumerate(words) if x in ("WITH", "RETURN") and not (k and words[k - 1] in ("STARTS", "ENDS"))]
        if len(clauses) != 1 or words[clauses[0] : clauses[0] + 2] != ["RETURN", "DISTINCT"]:
            return False
        return not any(x.lower() in _AGGREGATES and words[k + 1 : k + 2] == ["("] for k, x in enumerate(words))

    # clauses ----------------------------------------------------------------------------------------------------
    def run(self) -> DataFrame:
        while self.k < len(self.t):
            if self.take("OPTIONAL", "MATCH"):
                self.match(True)
            elif self.take("MATCH"):
                self.match(False)
            elif self.take("CALL"):
                self.call()
            elif self.take("WITH"):
                self.project(False)
                if self.take("WHERE"):
                    self.rows = self.rows.where(self.expr())
            elif self.take("RETURN"):
                self.project(True)
                if self.k < len(self.t) and self.peek() != ";":
                    raise CypherError(f"can't read {self.peek()!r} after RETURN")
                return self.rows
            else:
                raise CypherError(f"can't read {self.peek()!r}")
        raise CypherError("no RETURN")

    def call(self) -> None:
        """CALL db.index.fulltext.queryNodes(index, term) YIELD node, score: hits among the words of names."""
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        if name.lower() != "db.index.fulltext.querynodes" or self.rows is not None:
            raise CypherError(f"can't call {name} here")
        self.need("(")
        self._text()
        self.need(",")
        hits = self.g.fulltext(self._text()).select("id", F.col("score").alias("_score"))
        self.need(")")
        self.need("YIELD")
        alias = {}
        while not alias or self.take(","):
            of = self.name()
            alias[of] = self.name() if self.take("AS") else of
        if not set(alias) <= {"node", "score"}:
            raise CypherError("node and score can be yielded")
        found = self.g.nodes.join(hits, "id")
        self.rows = found.select(*[(F.struct(*[F.col(c) for c in self.g.nodes.columns]) if of == "node" else F.col("_score")).alias(a) for of, a in alias.items()])
        self.kinds = {a: "node" if of == "node" else "value" for of, a in alias.items()}
        if self.take("WHERE"):
            self.rows = self.rows.where(self.expr())

    def _text(self) -> str:
        kind, x = self.t[self.k] if self.k < len(self.t) else ("", "")
        self.k += 1
        if kind == "par" and x[1:] in self.params:
            return str(self.params[x[1:]])
        if kind != "str":
            raise CypherError(f"expected a text at {x!r}")
        return re.sub(r"\\(.)", r"\1", x[1:-1])

    def match(self, optional: bool) -> None:
        at, before = self.k, self.rows
        bound = dict(self.kinds)
        if optional and before is not None:
            shared = self._named(at) & set(bound)
            if not shared:
                raise CypherError("an optional pattern must share a variable with what is bound")
            self.rows = before.select(*sorted(shared)).distinct()
            self.kinds = {v: bound[v] for v in shared}
        used: list[str] = []
        self.tests = self._tests()
        self.pattern(used)
        while self.take(","):
            self.pattern(used)
        for i, a in enumerate(used):
            for b in used[:i]:
                self.rows = self.rows.where(~F.col(a)["_e"].eqNullSafe(F.col(b)["_e"]))
        if self.take("WHERE"):
            self.rows = self.rows.where(self.expr())
        if optional and before is not None:
            self.rows = self._joined(before, self.rows, sorted(shared), bound, "left")
            self.kinds = bound | {v: k for v, k in self.kinds.items() if v not in bound}

    def _named(self, at: int) -> set[str]:
        """Names up to the next clause (to find which bound variables a pattern shares)."""
        out, k = set(), at
        while k < len(self.t) and self.t[k][1].upper() not in ("RETURN", "WITH", "MATCH", "OPTIONAL", *_WRITES):
            if self.t[k][0] == "name":
                out.add(self.t[k][1])
            k += 1
        return out

    def _tests(self) -> dict[str, list[int]]:
        """Where, in the WHERE of the clause that begins here, the conditions begin that must hold and test one variable alone."""
        words, depth, k = [x.upper() if kind != "str" else "" for kind, x in self.t], 0, self.k
        starts: list[int] = []
        while k < len(words):
            w, word = words[k], self.t[k][0] == "name" and words[k - 1] not in (".", ":") and words[k + 1 : k + 2] != ["."]
            depth += (w in ("(", "[", "{") or word and w == "CASE") - (w in (")", "]", "}") or word and w == "END")
            if not depth and word:
                if w in ("RETURN", "MATCH", "OPTIONAL", "CALL", "ON", *_WRITES) or w == "WITH" and words[k - 1] not in ("STARTS", "ENDS"):
                    break
                if starts and w == "OR":
                    return {}
                if w == "WHERE" or starts and w == "AND":
                    starts.append(k + 1)
            k += 1
        out: dict[str, list[int]] = {}
        for a, b in zip(starts, [x - 1 for x in starts[1:]] + [k], strict=False):
            names = {self.t[i][1].strip("`") for i in range(a, b) if self.t[i][0] == "name" and words[i - 1] not in (".", ":") and words[i] not in _TESTS and words[i + 1 : i + 2] != ["("]}
            if len(names) == 1:
                out.setdefault(names.pop(), []).append(a)
        return out

    def pattern(self, used: list[str]) -> None:
        """One pattern. One that doesn't begin at a bound node is matched by itself and joined on what it shares."""
        k = self.k + 2 if self.peek(1) == "=" else self.k
        start = self.t[k + 1][1] if k + 1 < len(self.t) and self.t[k + 1][0] == "name" else None
        if self.rows is None or start in self.kinds:
            return self._pattern(used)
        before, bound = self.rows, dict(self.kinds)
        self.rows, self.kinds = None, {}
        self._pattern(used)
        shared = sorted(set(self.kinds) & set(bound))
        if not shared:
            raise CypherError(f"pattern with {start or 'an unnamed node'} shares no variable with what is bound")
        self.rows = self._joined(before, self.rows, shared, bound, "inner")
        self.kinds = bound | self.kinds

    def _joined(self, left: DataFrame, right: DataFrame, shared: list[str], kinds: dict[str, str], how: str) -> DataFrame:
        right = right.select(*[F.col(v).alias(f"_o_{v}" if v in shared else v) for v in right.columns])
        on = None
        for v in shared:
            same = F.col(v)["id"] == F.col(f"_o_{v}")["id"] if kinds[v] == "node" else F.col(v) == F.col(f"_o_{v}")
            on = same if on is None else on & same
        return left.join(right, on, how).drop(*[f"_o_{v}" for v in shared])

    def _pattern(self, used: list[str]) -> None:
        path = None
        if self.peek(1) == "=" and self.t[self.k][0] == "name":
            path = self.name()
            self.need("=")
        left = self.node(None)
        steps: list[tuple[str, str]] = []
        while self.peek() in ("-", "<-", "<"):
            back = self.take("<-") or (self.take("<") and self.take("-"))
            if not back:
                self.need("-")
            var, types, props, low, high, many = None, [], {}, None, None, False
            if self.take("["):
                if self.t[self.k][0] == "name":
                    var = self.name()
                if self.take(":"):
                    types.append(self.name())
                    while self.take("|"):
                        self.take(":")
                        types.append(self.name())
                if self.take("*"):
                    low = high = None
                    if self.t[self.k][0] == "num":
                        low = high = int(self.peek())
                        self.k += 1
                    if self.take(".."):
                        low, high = low or 1, None
                        if self.t[self.k][0] == "num":
                            high = int(self.peek())
                            self.k += 1
                    low = low or 1
                    many = True
                if self.peek() == "{":
                    props = self.map()
                self.need("]")
            forward = self.take("->") or False
            if not forward:
                self.need("-")
                forward = self.take(">")
            direction = "in" if back else "out" if forward else "both"
            self.fresh += 1
            rel = var or f"_r{self.fresh}"
            left = self.hop(left, rel, types, props, direction, low if many else None, high, used, bool(var) or bool(path))
            steps.append((rel, left))
        if path:
            self._path(path, steps)

    def _path(self, path: str, steps: list[tuple[str, str]]) -> None:
        if len(steps) != 1 or self.kinds[steps[0][0]] != "rels":
            ids = F.array(*[F.col(n)["id"] for n in [self.first, *[n for _, n in steps]]])
            rels = F.array(*[F.col(r) for r, _ in steps])
        else:
            ids, rels = F.col(steps[0][0])["nodes"], F.col(steps[0][0])["rels"]
        self.rows = self.rows.withColumn(path, F.struct(ids.alias("nodes"), rels.alias("rels")))
        self.kinds[path] = "path"

    def node(self, via: DataFrame | None) -> str:
        self.need("(")
        var = self.name() if self.t[self.k][0] == "name" else None
        self.fresh += 1
        var = var or f"_n{self.fresh}"
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.map() if self.peek() == "{" else {}
        self.need(")")
        self._want = (var, labels, props)
        if via is None:
            self.bare = None if var in self.kinds or props or var in self.tests else var
            if var in self.kinds:
                self.rows = self._only(self.rows, var, labels, props)
            else:
                if self.rows is not None:
                    raise CypherError(f"pattern with {var} shares no variable with what is bound")
                self.rows = self._nodes(var, labels, props)
                self.kinds[var] = "node"
            self.first = var
        return var

    def _only(self, rows: DataFrame, var: str, labels: list[str], props: dict) -> DataFrame:
        if labels:
            rows = rows.where(F.col(var)["label"].isin(*labels))
        for k, v in props.items():
            rows = rows.where(self._get(F.col(var), k, self.node_columns) == v)
        return rows

    def _nodes(self, var: str, labels: list[str], props: dict) -> DataFrame:
        n = self.g.nodes
        if labels:
            n = n.where(F.col("label").isin(*labels))
        for k, v in props.items():
            n = n.where((F.col(_snake(k)) if _snake(k) in self.node_columns else F.lit(None)) == v)
        return n.select(F.struct("*").alias(var))

    def _far(self, var: str, labels: list[str], props: dict) -> DataFrame:
        """The filtered nodes at a far end, written: so few that they can be broadcast are then known to be few."""
        before, kinds, at = self.rows, self.kinds, self.k
        self.rows, self.kinds = self._nodes(var, labels, props), {var: "node"}
        for k in self.tests.get(var, ()):
            self.k = k
            self.rows = self.rows.where(self._not())
        found = scratch.materialize(self.rows, "ends")
        self.rows, self.kinds, self.k = before, kinds, at
        return found

    def hop(self, left: str, rel: str, types: list[str], props: dict, direction: str, low, high, used: list[str], keep: bool) -> str:
        e = self.g.edges
        if types:
            e = e.where(F.col("label").isin(*types))
        for k, v in props.items():
            e = e.where(F.col(_snake(k)) == v)
        right = self.node(e)
        var, labels, node_props = self._want
        step = F.struct("*", F.concat_ws("|", "src", "dst", "label").alias("_e"))
        out = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), step.alias("_s"))
        into = e.select(F.col("dst").alias("_a"), F.col("src").alias("_b"), step.alias("_s"))
        hops = {"out": out, "in": into}.get(direction)
        if hops is None:
            hops = out.unionAll(into.where("_a <> _b"))
        far = self.bare == left and low is None and right not in self.kinds and bool(node_props or right in self.tests)
        self.bare = None
        if far:
            hops = hops.join(self._far(right, labels, node_props), F.col("_b") == F.col(right)["id"])
        if low is None:
            rows = self.rows.join(hops, F.col(left)["id"] == F.col("_a")).withColumnRenamed("_s", rel).drop("_a")
            self.kinds[rel] = "rel"
            used.append(rel)
        else:
            ends = self.ends_only and not keep and direction != "both" and low == 1 and high is None
            rows = self._ends(left, rel, hops) if ends else self._lengths(left, rel, hops, low, high)
            self.kinds[rel] = "rels"
        if far:
            rows = rows.drop("_b")
            self.kinds[right] = "node"
        elif right in self.kinds and right in rows.columns:
            rows = self._only(rows.where(F.col(right)["id"] == F.col("_b")), var, labels, node_props).drop("_b")
        else:
            rows = rows.join(self._nodes(right, labels, node_props), F.col("_b") == F.col(right)["id"]).drop("_b")
            self.kinds[right] = "node"
        self.rows = rows
        return right

    def _ends(self, left: str, rel: str, hops: DataFrame) -> DataFrame:
        """All that one relationship or more lead to, as _b, each once for a start; a start only by way of a cycle."""
        from ..operators.paths import reach

        edges = scratch.materialize(hops.select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct(), "hops")
        start = self.rows.select(F.col(left)["id"].alias("id")).distinct()
        seen = reach(edges, start, by_root=True).select("root", "id")
        ends = seen.join(edges, seen["id"] == edges["src"]).select(F.col("root").alias("_root"), F.col("dst").alias("_b")).distinct()
        return self.rows.join(ends.withColumn(rel, F.lit(None)), F.col(left)["id"] == F.col("_root")).drop("_root")

    def _lengths(self, left: str, rel: str, hops: DataFrame, low: int, high: int | None) -> DataFrame:
        """Paths of low..high relationships without repeats, as _b and a struct (nodes, rels); each level is written once.

        Without ``high`` levels go on until no path can grow. A query's own limit on depth is an error where longer
        paths exist, never a cut.
        """
        start = self.rows.select(F.col(left)["id"].alias("_root")).distinct()
        now = start.select("_root", F.col("_root").alias("_at"), F.array("_root").alias("_n"), F.array().cast(f"array<{dict(hops.dtypes)['_s']}>").alias("_l"))
        found, k = None, 0
        while high is None or k < high:
            k += 1
            step = now.join(hops, (F.col("_at") == F.col("_a")) & ~F.exists("_l", lambda x: x["_e"] == F.col("_s")["_e"]))
            step = step.select("_root", F.col("_b").alias("_at"), F.concat("_n", F.array("_b")).alias("_n"), F.concat("_l", F.array("_s")).alias("_l"))
            now, n = scratch.counted(step, "paths")
            if n and self.max_depth is not None and k > self.max_depth:
                raise CypherError(f"there are paths of more than {self.max_depth} relationships")
            if k >= low or not n:
                found = now if found is None else found.unionAll(now)
            if not n:
                break
        found = found.select("_root", F.col("_at").alias("_b"), F.struct(F.col("_n").alias("nodes"), F.col("_l").alias("rels")).alias(rel))
        return self.rows.join(found, F.col(left)["id"] == F.col("_root")).drop("_root")

    def map(self) -> dict:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            self.take(",")
        return out

    # projection -------------------------------------------------------------------------------------------------
    def project(self, last: bool) -> None:
        distinct = self.take("DISTINCT")
        items: list[tuple[str, Column, bool, str]] = []
        if self.take("*"):
            items = [(v, F.col(v), False, k) for v, k in self.kinds.items() if v in self.rows.columns and not v.startswith("_")]
        while not items or self.take(","):
            at, self.aggregated = self.k, False
            c = self.expr()
            single = self.k == at + 1 and self.t[at][1] in self.kinds
            text = "".join(x for _, x in self.t[at : self.k])
            alias = self.name() if self.take("AS") else text
            items.append((alias, c, self.aggregated, self.kinds[self.t[at][1]] if single else "value"))
        keys = [(n, c) for n, c, a, _ in items if not a]
        before, kinds = self.rows, dict(self.kinds)
        grouped = any(a for _, _, a, _ in items)
        if grouped:
            pre = before.select(*[c.alias(f"_k{i}") for i, (_, c) in enumerate(keys)], *before.columns)
            aggs = [c.alias(n) for n, c, a, _ in items if a]
            out = pre.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(*aggs)
            out = out.select(*[F.col(f"_k{keys.index((n, c))}").alias(n) if not a else F.col(f"`{n}`") for n, c, a, _ in items])
        else:
            out = before.select(*[c.alias(n) for n, c, _, _ in items], *([] if distinct else [F.col(v).alias(f"_was_{v}") for v in before.columns]))
        if distinct:
            out = out.distinct()
        new = {n: k for n, _, _, k in items}
        order = []
        if self.take("ORDER", "BY"):
            while not order or self.take(","):
                at = self.k
                named = self._item_at(items)
                if named is not None:
                    c = F.col(f"`{named}`")
                else:
                    self.k = at
                    self.kinds = new if grouped or distinct else {v: k for v, k in kinds.items()} | new
                    self.local = {} if grouped or distinct else {v: (F.col(f"_was_{v}"), k) for v, k in kinds.items() if v not in new and f"_was_{v}" in out.columns}
                    c = self.expr()
                    self.local = {}
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                order.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        self.kinds = new
        if order:
            out = out.orderBy(*order)
        if self.take("SKIP"):
            out = out.offset(self._number())
        if self.take("LIMIT"):
            out = out.limit(self._number())
        self.rows = out.select(*[F.col(f"`{n}`") for n, *_ in items])
        if last:
            self.rows = self.rows.select(*[self._public(n, k) for n, _, _, k in items])

    def _item_at(self, items) -> str | None:
        """The name of the item that is written here in full, or by its alias."""
        best = None
        for n, *_ in items:
            k, text = self.k, ""
            while k < len(self.t) and len(text) < len(n):
                text += self.t[k][1]
                k += 1
            if text == n and (k >= len(self.t) or self.t[k][1] not in (".", "(", "[")) and (best is None or k > best[1]):
                best = (n, k)
        if best:
            self.k = best[1]
            return best[0]
        return None

    def _public(self, name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "rel":
            return c.dropFields("_e").alias(name)
        if kind in ("rels", "path"):
            return c.withField("rels", F.transform(c["rels"], lambda x: x.dropFields("_e"))).alias(name)
        return c

    def _number(self) -> int:
        kind, x = self.t[self.k]
        self.k += 1
        return int(self.params[x[1:]]) if kind == "par" else int(x)

    # expressions ------------------------------------------------------------------------------------------------
    def expr(self) -> Column:
        c = self._and()
        while self.take("OR"):
            c = c | self._and()
        return c

    def _and(self) -> Column:
        c = self._not()
        while self.take("AND"):
            c = c & self._not()
        return c

    def _not(self) -> Column:
        return ~self._not() if self.take("NOT") else self._compare()

    def _compare(self) -> Column:
        c = self._sum()
        while True:
            if self.take("IS", "NOT", "NULL"):
                c = c.isNotNull()
            elif self.take("IS", "NULL"):
                c = c.isNull()
            elif self.take("STARTS", "WITH"):
                c = c.startswith(self._sum())
            elif self.take("ENDS", "WITH"):
                c = c.endswith(self._sum())
            elif self.take("CONTAINS"):
                c = c.contains(self._sum())
            elif self.take("IN"):
                c = F.array_contains(self._sum(), c)
            elif self.take("=~"):
                c = c.rlike(self._sum())
            elif self.take("="):
                c = c == self._sum()
            elif self.take("<>"):
                c = c != self._sum()
            elif self.take("<="):
                c = c <= self._sum()
            elif self.take(">="):
                c = c >= self._sum()
            elif self.take("<"):
                c = c < self._sum()
            elif self.take(">"):
                c = c > self._sum()
            else:
                return c

    def _sum(self) -> Column:
        c = self._product()
        while self.peek() in ("+", "-"):
            if self.take("+"):
                right = self._product()
                c = F.concat(c, right) if self._texty(c) or self._texty(right) else c + right
            else:
                self.need("-")
                c = c - self._product()
        return c

    def _texty(self, c: Column) -> bool:
        try:
            kind = self.rows.select(c.alias("x")).schema["x"].dataType.typeName() if not self.local else ""
        except Exception:  # an aggregate, or a variable of a comprehension
            return False
        return kind == "string"

    def _product(self) -> Column:
        c = self._atom()
        while self.peek() in ("*", "/", "%"):
            op = self.peek()
            self.k += 1
            right = self._atom()
            c = c * right if op == "*" else c / right if op == "/" else c % right
        return c

    def _get(self, c: Column, key: str, known: set[str]) -> Column:
        k = _snake(key)
        return c[k] if k in known else F.lit(None)

    def _variable(self, v: str) -> tuple[Column, str]:
        if v in self.local:
            return self.local[v]
        if v in self.kinds:
            return F.col(f"`{v}`"), self.kinds[v]
        raise CypherError(f"unknown variable {v}")

    def _atom(self) -> Column:
        kind, x = self.t[self.k] if self.k < len(self.t) else ("", "")
        if kind == "num":
            self.k += 1
            return F.lit(float(x) if "." in x else int(x))
        if kind == "str":
            self.k += 1
            return F.lit(re.sub(r"\\(.)", r"\1", x[1:-1]))
        if kind == "par":
            self.k += 1
            if x[1:] not in self.params:
                raise CypherError(f"no value for {x}")
            v = self.params[x[1:]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if self.take("-"):
            return -self._atom()
        if self.take("("):
            c = self.expr()
            self.need(")")
            return self._after(c, "value")
        if self.take("["):
            return self._list()
        if self.take("CASE"):
            return self._case()
        upper = x.upper()
        if upper in ("TRUE", "FALSE", "NULL") and kind == "name":
            self.k += 1
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[upper])
        if kind == "name" and self.peek(1) == "(":
            return self._function()
        c, k = self._variable(self.name())
        return self._after(c, k)

    def _after(self, c: Column, kind: str) -> Column:
        while True:
            if self.peek() == "." and self.t[self.k + 1][0] == "name":
                self.k += 1
                known = self.node_columns if kind == "node" else self.edge_columns if kind == "rel" else None
                key = self.name()
                c, kind = (self._get(c, key, known) if known is not None else c[_snake(key)]), "value"
            elif self.take("["):
                c = c[self.expr()]
                self.need("]")
            elif self.peek() == ":" and kind == "node":
                self.k += 1
                c, kind = c["label"] == self.name(), "value"
            else:
                return c

    def _list(self) -> Column:
        if self.t[self.k][0] == "name" and self.peek(1).upper() == "IN":
            var = self.name()
            self.need("IN")
            source, kind = self._typed()
            at = self.k
            if self.take("WHERE"):
                at = self.k
                source = F.filter(source, lambda v: self._with(var, v, kind, at))
            if self.take("|"):
                at = self.k
                source = F.transform(source, lambda v: self._with(var, v, kind, at))
            self.need("]")
            return source
        items = []
        while not self.take("]"):
            items.append(self.expr())
            self.take(",")
        return F.array(*items)

    def _typed(self) -> tuple[Column, str]:
        """A list and what its members are."""
        fn = self.peek().lower()
        kind = "rel" if fn == "relationships" else "value"
        return self._sum(), kind

    def _with(self, var: str, value: Column, kind: str, at: int) -> Column:
        old, self.k = dict(self.local), at
        self.local[var] = (value, kind)
        c = self.expr()
        self.local = old
        return c

    def _case(self) -> Column:
        subject = None if self.is_("WHEN") else self.expr()
        out = None
        while self.take("WHEN"):
            test = self.expr()
            test = test if subject is None else subject == test
            self.need("THEN")
            value = self.expr()
            out = F.when(test, value) if out is None else out.when(test, value)
        if self.take("ELSE"):
            out = out.otherwise(self.expr())
        self.need("END")
        return out

    def _function(self) -> Column:
        fn = self.name().lower()
        self.need("(")
        if fn in ("any", "all", "none"):
            var = self.name()
            self.need("IN")
            source, kind = self._typed()
            self.need("WHERE")
            at = self.k
            test = {"any": F.exists, "none": lambda c, f: ~F.exists(c, f), "all": F.forall}[fn](source, lambda v: F.coalesce(self._with(var, v, kind, at), F.lit(False)))
            self.need(")")
            return test
        if fn == "count" and self.take("*"):
            self.need(")")
            self.aggregated = True
            return F.count(F.lit(1))
        if fn in _AGGREGATES:
            distinct = self.take("DISTINCT")
            c = self.expr()
            self.need(")")
            self.aggregated = True
            if distinct:
                return F.countDistinct(c) if fn == "count" else F.collect_set(c) if fn == "collect" else _AGGREGATES[fn](c)
            return _AGGREGATES[fn](c)
        if fn in ("labels", "type", "id", "elementid", "length", "nodes", "relationships"):
            c, kind = self._variable(self.name())
            self.need(")")
            if fn == "labels":
                return self._after(F.array(c["label"]), "value")
            if fn == "type":
                return c["label"]
            if fn in ("id", "elementid"):
                return c["id"] if kind == "node" else c["_e"]
            return {"length": lambda: F.size(c["rels"]), "nodes": lambda: c["nodes"], "relationships": lambda: c["rels"] if kind in ("path", "rels") else c}[fn]()
        if fn not in _SCALARS:
            raise CypherError(f"unknown function {fn}")
        args = []
        while not self.take(")"):
            args.append(self.expr())
            self.take(",")
        return self._after(_SCALARS[fn](*args), "value")


def cypher(graph: PropertyGraph, text: str, params: dict | None = None, max_depth: int | None = None) -> DataFrame:
    """The rows that a read-only query returns. max_depth: refuse patterns that have longer paths than this."""
    guard(text)
    return _Query(graph, text, params or {}, max_depth).run()

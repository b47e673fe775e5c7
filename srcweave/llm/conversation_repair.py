"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Each row is kept (0), given the other role that fits (1) or deleted (2; blank and duplicate rows must go), and rows with
an empty text may be inserted (5); a truncated row that stays costs 5 more. The grammar has four states: nothing yet (E),
after the system's row (S), after the user's (U), after the assistant's (A). The work is dealt by hash of conversation and
range of turns; a task hands batches of ``BATCH`` rows to DuckDB, where one recursive query advances all conversations of
the batch by a row in each step and keeps, for each grammar state, the least cost and the least audit of that cost. (An
audit can't begin with another one of the same rows, so the least of a part stays the least of the whole.)

A conversation of more than ``TURNS`` turns, or of more rows than a batch in one range of turns, is several units. Units
after its first are walked from each of the four states, and what they cost from state to state is folded along the
conversation afterwards, with one running hash for each state: its rows stream by and are never held together. Which
texts were seen earlier is told by 128-bit hashes beforehand, so that no window needs a conversation's rows in one place.

Cases: null roles and texts are one blank and so a role that must change and a blank row; null turns come first; rows of
equal turns go by role and text, so repeated rows are neighbours; a null conversation id is a conversation; a role counts
by its first character, and one that isn't s, u or a can't be kept; an empty table gives an empty result. Other columns
aren't read. Only audits, which are values of the result, grow with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans import scratch
from .native import BLANKS

TURNS = 1024
BATCH = 4096
BATCH_BYTES = 16 << 20
STATES = "ESUA"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_NEXT = {"E": "U", "S": "U", "U": "A", "A": "U"}  # the state after a new role or an inserted row
_KEPT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
_ROLE = {"U": "user", "A": "assistant"}
_FAULTS = ("", "blank", "duplicate", "truncated")


def _moves() -> list[tuple[str, str, str, str, int]]:
    """(kind of row: initial and fault, state, next state, edits, cost), the best of each."""
    best: dict = {}
    for initial in "sua-":
        for fault in _FAULTS:
            stay = TRUNCATED if fault == "truncated" else 0
            for source in STATES:
                at, before, paid = source, "", 0
                for _ in range(3):  # up to two rows inserted before this one lead to any state
                    ways = [(at, "D", DELETE)]
                    if fault in ("", "truncated"):
                        ways.append((_NEXT[at], "R", REROLE + stay))
                        if (at, initial) in _KEPT:
                            ways.append((_KEPT[at, initial], "K", KEEP + stay))
                    for target, edit, cost in ways:
                        key, way = (initial + fault, source, target), (paid + cost, before + edit)
                        best[key] = min(best.get(key, way), way)
                    at, before, paid = _NEXT[at], before + "I", paid + INSERT
    return [(*key, edits, cost) for key, (cost, edits) in best.items()]


_WALK = """
WITH RECURSIVE walk AS (
  SELECT unit, source, 0 AS pos, source AS state, 0 AS cost, '' AS audit FROM units JOIN starts ON starts.inner_unit = units.inner_unit
  UNION ALL
  SELECT unit, source, pos, state, best.cost, best.audit FROM (
    SELECT w.unit, w.source, w.pos + 1 AS pos, m.target AS state, min({'cost': w.cost + m.cost, 'audit': w.audit || m.edits}) AS best
    FROM walk w JOIN turns t ON t.unit = w.unit AND t.pos = w.pos JOIN moves m ON m.kind = t.kind AND m.source = w.state
    GROUP BY w.unit, w.source, w.pos, m.target)
)
SELECT unit, source, state, cost, audit FROM walk JOIN units USING (unit) WHERE walk.pos = units.n ORDER BY unit, source, state"""


class _Walker:
    """The recursive query over batches of units."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": "1"})
        self.db.execute("CREATE TABLE moves (kind VARCHAR, source VARCHAR, target VARCHAR, edits VARCHAR, cost BIGINT)")
        self.db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", _moves())
        self.db.execute("CREATE TABLE starts AS SELECT * FROM (VALUES (false, 'E'), (true, 'E'), (true, 'S'), (true, 'U'), (true, 'A')) AS v(inner_unit, source)")

    def walk(self, units: list[list[str]], inner: list[bool]) -> list[list[dict]]:
        """For each unit, given as the kinds of its rows: the ways (source, state, cost, audit) through it."""
        turns = pa.table({"unit": pa.array([u for u, kinds in enumerate(units) for _ in kinds], pa.int32()), "pos": pa.array([p for kinds in units for p in range(len(kinds))], pa.int32()), "kind": pa.array([k for kinds in units for k in kinds], pa.string())})
        heads = pa.table({"unit": pa.array(range(len(units)), pa.int32()), "n": pa.array([len(kinds) for kinds in units], pa.int32()), "inner_unit": pa.array(inner, pa.bool_())})
        self.db.register("turns", turns)
        self.db.register("units", heads)
        ways: list[list[dict]] = [[] for _ in units]
        for unit, source, state, cost, audit in self.db.execute(_WALK).fetchall():
            ways[unit].append({"source": source, "state": state, "cost": cost, "audit": audit})
        return ways


def _lines(audit: str, rows: list[tuple[str, str]], state: str) -> Iterator[tuple[str, str]]:
    """(state, line) of what is left of the rows after the edits."""
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = _KEPT[state, role[:1]]
        else:
            state = _NEXT[state]
            role = _ROLE[state]
        yield state, f"{role}:{text}"


class _Paths:
    """The best path to each grammar state: (cost, place among the audits, audit as a chain of parts, running hash)."""

    def __init__(self):
        self.at = {"E": (0, 0, None, hashlib.sha256())}

    def go(self, ways: list[dict], rows: list[tuple[str, str]]) -> None:
        best: dict = {}
        for w in ways:
            if w["source"] in self.at:
                cost, rank, _, _ = self.at[w["source"]]
                key = (cost + w["cost"], rank, w["audit"], w["source"])
                best[w["state"]] = min(best.get(w["state"], key), key)
        order = {x: k for k, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        found = {}
        for state, (cost, rank, audit, source) in best.items():
            sha = self.at[source][3].copy()
            begun = source != "E"
            for _, line in _lines(audit, rows, source):
                sha.update((("\n" if begun else "") + line).encode())
                begun = True
            found[state] = (cost, order[rank, audit], (self.at[source][2], audit), sha)
        self.at = found

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired conversation)."""
        ways = []
        for state, (cost, rank, chain, sha) in self.at.items():
            rest = {"E": [], "A": [], "U": ["assistant:"], "S": ["user:", "assistant:"]}[state]
            ways.append((cost + INSERT * len(rest), rank, "I" * len(rest), chain, rest, sha))
        cost, _, last, chain, rest, sha = min(ways, key=lambda w: w[:3])
        parts = [last]
        while chain:
            chain, part = chain
            parts.append(part)
        for line in rest:
            sha.update(("\n" + line).encode())
        return cost, "".join(reversed(parts)), sha.hexdigest()


_UNIT = "conv string, piece long, part int, n int, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<struct<source:string,state:string,cost:long,audit:string>>, cost long, audit string, repaired_sha256 string"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list[dict], dict]]:
    """((conversation, range of turns, part), whether it is cut, rows, marks) from sorted rows; marks come before rows."""
    key, part, rows, size, marks = None, 0, [], 0, {}
    for b in batches:
        for r in b.to_pylist():
            if (r["conv"], r["piece"]) != key:
                if rows or part == 0 and key:
                    yield (*key, part), rows, marks
                key, part, rows, size, marks = (r["conv"], r["piece"]), 0, [], 0, {}
            if r["kind"] == 0:
                marks[r["h"]] = r["turn"]
                continue
            rows.append(r)
            size += len(r["text"])
            if len(rows) >= BATCH or size >= BATCH_BYTES:
                yield (*key, part), rows, marks
                part, rows, size, marks = part + 1, [], 0, marks | {"last": r}
    if rows or part == 0 and key:
        yield (*key, part), rows, marks


def _fault(r: dict, before: dict | None, marks: dict) -> str:
    if r["ending"] == "":
        return "blank"
    if before and (before["turn"], before["h"]) == (r["turn"], r["h"]) or r["h"] in marks and r["turn"] is not None and (marks[r["h"]] is None or r["turn"] > marks[r["h"]]):
        return "duplicate"
    return "" if r["ending"] in (".", "!", "?") else "truncated"


def _initial(r: dict) -> str:
    return r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "-"


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unit; cost, audit and hash are those of a conversation that has no other unit."""
    walker, held, n, size = _Walker(), [], 0, 0
    schema = ["conv", "piece", "part", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways", "cost", "audit", "repaired_sha256"]

    def done():
        ways = walker.walk([[_initial(r) + f for r, f in zip(rows, faults, strict=True)] for _, rows, faults in held], [key[1:] != (0, 0) for key, *_ in held])
        out = []
        for ((conv, piece, part), rows, faults), w in zip(held, ways, strict=True):
            initials = [_initial(r) for r in rows]
            row = {"conv": conv, "piece": piece, "part": part, "n": len(rows), "first": initials[0], "last": initials[-1], "ways": w, "cost": None, "audit": None, "repaired_sha256": None}
            row |= {f: faults.count(f) for f in _FAULTS[1:]} | {"illegal": sum(map(_illegal, initials, initials[1:]))}
            if (piece, part) == (0, 0):
                paths = _Paths()
                paths.go(w, [(r["role"], r["text"]) for r in rows])
                row["cost"], row["audit"], row["repaired_sha256"] = paths.end()
            out.append(row)
        return pa.RecordBatch.from_pylist(out, schema=_arrow()).select(schema)

    for key, rows, marks in _units(batches):
        if rows:
            faults = [_fault(r, before, marks) for r, before in zip(rows, [marks.get("last"), *rows], strict=False)]
            held.append((key, rows, faults))
            n, size = n + len(rows), size + sum(len(r["text"]) for r in rows)
        if n >= BATCH or size >= BATCH_BYTES:
            yield done()
            held, n, size = [], 0, 0
    if held:
        yield done()


def _arrow() -> pa.Schema:
    way = pa.struct([("source", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c, kinds.get(t) or pa.list_(way)) for c, t in (x.split(" ", 1) for x in _UNIT.split(", "))])


_TOTAL = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of several units, from its units and rows sorted by conversation, range and kind."""
    names = [c.split()[0] for c in _TOTAL.split(", ")]
    conv, piece, sums, last, paths, heads, rows = None, None, None, None, None, [], []

    def total():
        cost, audit, sha = paths.end()
        return pa.RecordBatch.from_pylist([dict(zip(names, (conv, *sums, cost, audit, sha), strict=True))], schema=pa.schema([(c, pa.string() if c in ("conv", "audit", "repaired_sha256") else pa.int64()) for c in names]))

    for b in batches:
        for r in b.to_pylist():
            if paths is None or r["conv"] != conv:
                if paths is not None:
                    yield total()
                conv, sums, last, paths, heads, rows = r["conv"], [0, 0, 0, 0], None, _Paths(), [], []
            if r["kind"] == 0:
                heads.append(r)
                crossing = last is not None and _illegal(last, r["first"])
                sums = [s + r[c] for s, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                sums[3] += crossing
                last = r["last"]
                continue
            rows.append((r["role"], r["text"]))
            if len(rows) == heads[0]["n"]:
                paths.go(heads.pop(0)["ways"], rows)
                rows = []
    if paths is not None:
        yield total()


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a conversation table with faults planted by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("op"))
    text = F.when(F.col("op") == 1, F.lit("")).when(F.col("op") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = plain.where("op <> 0").select("conv_id", "turn", F.when(F.col("op") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("op") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return hit.drop("copy")


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def repair(rows: DataFrame, conversations: DataFrame | None = None, turns: int = TURNS) -> DataFrame:
    """Per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text).

    conversations: one column with the ids that get a row even without any turn.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(_key(F.col("conv_id").cast("long")).alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.withColumns({"piece": F.greatest(F.coalesce(F.floor(F.col("turn") / turns), F.lit(0)), F.lit(0)), "h": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), "ending": F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))})
    when = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    seen = rows.groupBy("conv", "h", "piece").agg(F.min(when).alias("lo"), F.max(when).alias("hi"))
    again = seen.groupBy("conv", "h").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least.some <> most.some or least.turn <> most.turn")
    marks = seen.join(again, ["conv", "h"]).select("conv", "piece", F.lit(0).alias("kind"), F.col("least.turn").alias("turn"), "h", F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("ending"))
    dealt = rows.select("conv", "piece", F.lit(1).alias("kind"), "turn", "h", "role", "text", "ending").unionByName(marks).repartition("conv", "piece").sortWithinPartitions("conv", "piece", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    units = scratch.materialize(dealt.mapInArrow(_walked, _UNIT), "units")

    many = units.groupBy("conv").agg(F.count("*").alias("k"), F.max("piece").alias("p")).where("k > 1 or p > 0").select("conv")
    totals = ("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    head = units.join(many, "conv", "left_semi").select("conv", "piece", F.lit(0).alias("kind"), "part", "n", *totals[1:5], "first", "last", "ways", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    body = rows.join(many, "conv", "left_semi").select("conv", "piece", F.lit(1).alias("kind"), "turn", "role", "text")
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "piece", "kind", "part", F.col("turn").asc_nulls_first(), "role", "text")
    whole = units.join(many, "conv", "left_anti").select(*totals).unionByName(both.mapInArrow(_folded, _TOTAL))

    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = gaps if conversations is None else conversations.toDF("conv").select(_key(F.col("conv").cast("long")).alias("conv")).distinct().join(gaps, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(whole, "conv", "left").select(
        F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), rows.select("conv_id"))

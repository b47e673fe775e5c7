"""Variable-length traversals.

``reach`` is breadth-first: each level joins the frontier with the edges, drops vertices seen already and goes on until
the frontier is empty or the bound is reached; each level is written to the shared checkpoint folder, which cuts
lineage and counts it. ``trails`` lists paths with no edge twice (the semantics of a variable-length pattern), growing arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import scratch
from .numbering import numbered


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) of the hops. Parallel edges stay: what is reached is made distinct, which is smaller than all edges."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return out if direction == "out" else back if direction == "in" else out.unionAll(back)


def reach(edges: DataFrame, start: DataFrame, direction: str = "out", depth: int | None = None, by_root: bool = False) -> DataFrame:
    """(root, id, depth): least number of hops from each root to each vertex; the roots have depth 0.

    Without by_root all of ``start`` is one root (null) and the state holds each vertex once. ``edges`` is read once for
    each level, two columns of it: it should be a stored table rather than a plan that computes it.
    """
    hops = directed(edges, direction)
    root = F.col("id") if by_root else F.lit(None).cast(start.schema["id"].dataType)
    seen = scratch.materialize(start.select(root.alias("root"), "id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(hops, frontier["id"] == hops["src"]).select("root", F.col("dst").alias("id")).distinct()
        known = seen.select(F.col("root").alias("_r"), F.col("id").alias("_i"))
        new = step.join(known, step["root"].eqNullSafe(known["_r"]) & (step["id"] == known["_i"]), "left_anti")
        if by_root and level == depth:  # the largest level by far, and nothing starts from it: it isn't written
            return seen.unionAll(new.withColumn("depth", F.lit(level)))
        frontier, found = scratch.counted(new.withColumn("depth", F.lit(level)), "reach")
        if not found:
            break
        seen = seen.unionAll(frontier)
        if level % 8 == 0:
            seen = scratch.materialize(seen, "reach")
    return seen


def walks(edges: DataFrame, start: DataFrame, direction: str = "in", depth: int = 3) -> DataFrame:
    """(root, id, depth) for each length 1..depth at which a walk leads from root to id: one row per length."""
    hops = directed(edges, direction)
    level = start.select(F.col("id").alias("root"), "id").distinct()
    out = None
    for k in range(1, depth + 1):
        step = level.join(hops, level["id"] == hops["src"]).select("root", F.col("dst").alias("id")).distinct()
        level = scratch.materialize(step, "walks")
        rows = level.withColumn("depth", F.lit(k))
        out = rows if out is None else out.unionAll(rows)
    return out


def trails(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out", flags: tuple[str, ...] = ()) -> DataFrame:
    """(root, id, length, nodes, edge flags) for every path of 1..depth edges with no edge twice.

    flags: boolean edge columns; each becomes an array with the path's values in order, so that ``any`` and ``none``
    are exists() over it. Edges between the same nodes that differ in label or line are different ones. Each level is
    written once and the next one starts from there.
    """
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.struct("src", "dst", *[x for x in ("label", "line") if x in edges.columns]).alias("_e"), *flags)
    now = start.select(F.col("id").alias("root"), "id", F.array("id").alias("nodes"), F.array().cast(f"array<{dict(e.dtypes)['_e']}>").alias("used"), *[F.array().cast("array<boolean>").alias(f"all_{x}") for x in flags])
    out = None
    for k in range(1, depth + 1):
        step = now.join(e, (now["id"] == e["_a"]) & ~F.array_contains(now["used"], e["_e"]))
        step = step.select(
            "root", F.col("_b").alias("id"), F.concat("nodes", F.array("_b")).alias("nodes"), F.concat("used", F.array("_e")).alias("used"),
            *[F.concat(f"all_{x}", F.array(F.coalesce(x, F.lit(False)))).alias(f"all_{x}") for x in flags],
        )
        now, found = scratch.counted(step, "trails")
        rows = now.withColumn("length", F.lit(k))
        out = rows if out is None else out.unionAll(rows)
        if not found:
            break
    return out.drop("used")


def tainted(paths: DataFrame) -> DataFrame:
    """Paths with a tainted edge and no sanitised one."""
    return paths.where(F.exists("all_tainted", lambda x: x) & ~F.exists("all_sanitized", lambda x: x))


def sanitized(paths: DataFrame) -> DataFrame:
    return paths.where(F.exists("all_sanitized", lambda x: x))


def flag_search(edges: DataFrame, start: DataFrame, flags: tuple[str, ...], direction: str = "out", depth: int | None = None, before: bool = True) -> DataFrame:
    """(root, id, mask, depth, from_id, from_mask): which flags (bit k for the k-th, six at most) walks from a root to a vertex meet.

    A search in the product of vertices and sets of flags: each (root, vertex, mask) is reached once, with the least
    number of edges and the least vertex and mask before it, so the state is bounded by roots x vertices x 2^flags
    however many paths there are. Roots are there with mask 0 and depth 0. A walk may use an edge again: to a vertex
    behind a cycle it meets what the cycle has. A vertex's roots and masks are the bits of a number (of one for every
    64 / 2^flags roots), so an edge sends one row for a level and not one for each of them. What comes before is found
    after the search, from the depths; without ``before`` these columns are left out. Short ids (numbers) shuffle less.
    """
    masks = 1 << len(flags)
    if masks > 64:
        raise ValueError("six flags at most")
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    met = F.lit(0)
    for k, x in enumerate(flags):
        met = met + F.when(F.coalesce(F.col(x), F.lit(False)), 1 << k).otherwise(0)
    hops = scratch.materialize(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), met.alias("_m")).where("_a is not null and _b is not null").distinct(), "flagged")
    roots = numbered(start.select("id").distinct(), "id", name="_no").withColumnsRenamed({"id": "root"})
    roots = scratch.materialize(roots.select("root", F.floor(F.col("_no") * masks / 64).cast("long").alias("_g"), (F.col("_no") * masks % 64).cast("int").alias("_at")), "roots")
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at"))
    seen = scratch.materialize(roots.select("_g", F.col("root").alias("id"), bits.alias("bits"), F.lit(0).alias("depth")), "search")
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(hops, frontier["id"] == hops["_a"]).select("_g", F.col("_b").alias("id"), _meet(F.col("bits"), masks, len(flags)).alias("bits"))
        step = step.groupBy("_g", "id").agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("_g", "id").agg(F.bit_or("bits").alias("_known"))
        new = step.join(known, ["_g", "id"], "left").select("_g", "id", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long")))).alias("bits"), F.lit(level).alias("depth"))
        frontier, found = scratch.counted(new.where("bits <> 0"), "search")
        if not found:
            break
        seen = seen.unionAll(frontier)
        if level % 8 == 0:
            seen = scratch.materialize(seen, "search")
    there = seen.select("_g", "id", "depth", F.explode(_places("bits")).alias("_p"))
    out = there.join(roots, (roots["_g"] == there["_g"]) & (F.col("_at") == F.col("_p") - F.col("_p") % masks)).select("root", "id", there["_g"], "_p", (F.col("_p") % masks).alias("mask"), "depth")
    if not before:
        return out.drop("_g", "_p")
    ends = seen.select("_g", F.col("id").alias("_b"), "depth", F.col("bits").alias("_to"))
    pairs = seen.join(hops, seen["id"] == hops["_a"]).select("_g", "_b", (F.col("depth") + 1).alias("depth"), "_a", "_m", F.col("bits").alias("_from")).join(ends, ["_g", "_b", "depth"])
    pairs = pairs.select("_g", "_b", "depth", "_a", "_m", "_to", F.explode(_places("_from")).alias("_u"))
    place = F.col("_u") - F.col("_u") % masks + (F.col("_u") % masks).bitwiseOR(F.col("_m"))
    pairs = pairs.withColumn("_p", place).where(F.call_function("getbit", F.col("_to"), F.col("_p")) == 1)
    least = pairs.groupBy("_g", "_b", "depth", "_p").agg(F.min(F.struct(F.col("_a").alias("from_id"), (F.col("_u") % masks).alias("from_mask"))).alias("_f"))
    out = out.join(least.select("_g", F.col("_b").alias("id"), "_p", "_f"), ["_g", "id", "_p"], "left")
    return out.select("root", "id", "mask", "depth", "_f.from_id", "_f.from_mask")


def _places(bits: str) -> Column:
    """Places of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.call_function("getbit", F.col(bits), p) == 1)


def _meet(bits: Column, masks: int, flags: int) -> Column:
    """Sets of flags (bits, ``masks`` to a root) after an edge with the flags ``_m``: those without a flag of it move to those with it."""
    for k in range(flags):
        without = sum(1 << p for p in range(64) if not (p % masks) >> k & 1)
        stay, move = bits.bitwiseAND(F.bitwise_not(F.lit(without).cast("long"))), bits.bitwiseAND(F.lit(without).cast("long"))
        bits = F.when(F.col("_m").bitwiseAND(F.lit(1 << k)) != 0, stay.bitwiseOR(F.shiftleft(move, 1 << k))).otherwise(bits)
    return bits


def witnesses(search: DataFrame, ends: DataFrame) -> DataFrame:
    """(root, id, mask, nodes): a shortest walk for each row (root, id, mask) of ``ends``, told backwards along the search."""
    back = search.select("root", F.col("id").alias("_id"), F.col("mask").alias("_mask"), F.col("from_id").alias("_f"), F.col("from_mask").alias("_fm"))
    now = ends.join(search, ["root", "id", "mask"]).select("root", "id", "mask", F.array("id").alias("nodes"), F.col("from_id").alias("at"), F.col("from_mask").alias("at_mask"))
    out = None
    while True:
        now, found = scratch.counted(now, "witnesses")
        done = now.where("at is null").select("root", "id", "mask", "nodes")
        out = done if out is None else out.unionAll(done)
        if not found:
            return out
        open_ = now.where("at is not null")
        step = open_.join(back, (open_["root"] == back["root"]) & (F.col("at") == F.col("_id")) & (F.col("at_mask") == F.col("_mask")))
        now = step.select(open_["root"], "id", "mask", F.concat(F.array("at"), "nodes").alias("nodes"), F.col("_f").alias("at"), F.col("_fm").alias("at_mask"))


def first_trails(edges: DataFrame, start: DataFrame, limit: int, direction: str = "out", depth: int | None = None) -> DataFrame:
    """(root, id, length, nodes) of the first ``limit`` paths with no edge twice, by length and then by their nodes.

    As every shorter path comes first, a level is only grown while all paths so far are fewer than the limit, and of
    its own paths only as many as are still wanted stay. So no level starts from more rows than the limit, which is why
    it may be broadcast, and what is written grows with the limit rather than with the number of paths.
    """
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.struct("src", "dst", *[x for x in ("label", "line") if x in edges.columns]).alias("_e"))
    now = start.select(F.col("id").alias("root"), "id", F.array("id").alias("nodes"), F.array().cast(f"array<{dict(e.dtypes)['_e']}>").alias("used")).distinct()
    out, left, length = None, limit, 0
    while left > 0 and (depth is None or length < depth):
        length += 1
        small = F.broadcast(now) if length > 1 else now
        step = e.join(small, (F.col("_a") == F.col("id")) & ~F.array_contains("used", F.col("_e")))
        step = step.select("root", F.col("_b").alias("id"), F.concat("nodes", F.array("_b")).alias("nodes"), F.concat("used", F.array("_e")).alias("used"))
        now, found = scratch.counted(step.orderBy("nodes", "used").limit(left), "first")
        rows = now.select("root", "id", F.lit(length).alias("length"), "nodes")
        out = rows if out is None else out.unionAll(rows)
        left -= found
        if not found:
            break
    return out


def dependency_tree(edges: DataFrame, start: DataFrame, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (id, depth) and edges below the start, at most ten levels deep."""
    nodes = reach(edges, start, "out", min(depth, 10)).select("id", "depth")
    inner = nodes.where(F.col("depth") < min(depth, 10)).select(F.col("id").alias("src"))
    return nodes, edges.join(inner, "src", "left_semi").select("src", "dst").distinct()

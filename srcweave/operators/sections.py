"""Sections of documents: where each ends, and under which it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed value: ranks of headings.
LEVELS = 6
PART = 10_000  # lines of a document that are looked through together


def section_spans(sections: DataFrame, documents: DataFrame, part: int = PART) -> DataFrame:
    """Sections (file_path, start_line, level, id, ...) with end_line (before the next heading of the same or a higher rank,
    else the document's end) and parent_id (the nearest heading before of a higher rank).

    The nearest smaller level is what a stack would show, and with six ranks a stack is the last heading of each rank: one
    pass in order of lines carries these along. A long document is cut into parts of ``part`` lines, passes stay within a
    part, and what a part begins with comes from one row for each part before it, so no document is held in one place.
    Levels run from 1 to ``LEVELS``; headings on one line don't stand under each other; null levels have neither end nor
    parent of their own.
    """
    rows = sections.withColumn("_part", F.floor(F.col("start_line") / part))
    here = F.struct("start_line", "id")
    of = lambda k, pick: pick(F.when(F.col("level") == k, here), F.col("start_line")).alias(f"p{k}")
    ranks = range(1, LEVELS + 1)
    sums = rows.groupBy("file_path", "_part")
    ends = sums.agg(*[of(k, lambda x, _: F.max(x)).alias(f"b{k}") for k in ranks], *[of(k, lambda x, _: F.min(x)).alias(f"a{k}") for k in ranks])
    parts = Window.partitionBy("file_path").orderBy("_part")
    carried = ends.select(
        "file_path", "_part", *[F.last(f"b{k}", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"b{k}") for k in ranks],
        *[F.first(f"a{k}", ignorenulls=True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias(f"a{k}") for k in ranks],
    )
    lines = Window.partitionBy("file_path", "_part").orderBy("start_line")
    up, down = lines.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_path", "_part").orderBy(F.desc("start_line")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"i{k}": F.max(F.when(F.col("level") == k, here)).over(up) for k in ranks} | {f"j{k}": F.min(F.when(F.col("level") == k, here)).over(down) for k in ranks})
    rows = rows.join(carried, ["file_path", "_part"])
    rows = rows.join(documents.select("file_path", F.col("lines").alias("_last")), "file_path")
    nearest = lambda k: F.coalesce(f"i{k}", f"b{k}")
    next_ = lambda k: F.coalesce(f"j{k}", f"a{k}")
    above = F.greatest(*[F.when(F.col("level") > k, nearest(k)) for k in ranks])
    below: Column = F.least(*[F.when(F.col("level") >= k, next_(k)) for k in ranks])
    return rows.select(*sections.columns, F.coalesce(below["start_line"] - 1, "_last").cast("int").alias("end_line"), above["id"].alias("parent_id"))

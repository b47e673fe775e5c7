"""Queries of references kept up to date by change sets: orders are files, which define their first item's part and refer
to the parts of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.linkstore import LinkStore
from . import scratch
from .roster import query
from .testgraph import Tables

LINKS = """WITH x AS (SELECT l_orderkey AS file, l_partkey AS name, CASE WHEN l_linenumber = 1 THEN 'def' ELSE 'ref' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey {where})
SELECT CAST(r.file AS VARCHAR) AS src, CAST(d.file AS VARCHAR) AS dst, CAST(r.name AS VARCHAR) AS name, count(*) AS n FROM x r JOIN x d ON r.name = d.name WHERE r.kind = 'ref' AND d.kind = 'def' GROUP BY 1, 2, 3"""


def _files(t: Tables) -> DataFrame:
    """(file, name, kind, n, day) of every order."""
    items = t.table("lineitem").join(t.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.when(F.col("l_linenumber") == 1, "def").otherwise("ref")
    return items.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_partkey").cast("string").alias("name"), kind.alias("kind"), F.lit(1).cast("long").alias("n"), F.col("o_orderdate").cast("date").alias("day"))


def _store(t: Tables) -> tuple[LinkStore, DataFrame, DataFrame]:
    """The orders before the last month as one set, then the last month's by halves, the second half before with other rows."""
    rows, store = scratch.materialize(_files(t), "orders"), LinkStore(t.spark, scratch.new_path(t.spark, "links"))
    month = F.col("day") >= F.trunc(F.lit(rows.agg(F.max("day")).first()[0]), "month")
    late = F.dayofmonth("day") > 15
    store.apply(rows.where(~month).unionByName(rows.where(month & late).withColumn("kind", F.lit("def"))).drop("day"))
    store.apply(rows.where(month & ~late).drop("day"))
    store.apply(rows.where(month & late).drop("day"))
    return store, rows, rows.where(month)


@query(LINKS.format(where=""))
def links_by_change_sets(t: Tables):
    return _store(t)[0].edges()


@query(LINKS.format(where="WHERE date_trunc('month', o_orderdate) < (SELECT date_trunc('month', max(o_orderdate)) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"))
def links_after_removal(t: Tables):
    """The last month's orders go again; what is left is compacted."""
    store, rows, month = _store(t)
    store.apply(rows.where("false").drop("day"), month.select("file").distinct())
    store.compact()
    return store.edges()

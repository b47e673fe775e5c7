"""Queries of the stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.textindex import PageIndex, TextIndex, TrigramIndex
from . import scratch
from .roster import query
from .testgraph import Tables

_BUILT: dict = {}


def _index(t: Tables, name: str, build):
    """An index over the folder's tables, made at the first use in a session."""
    key = (t.spark.sparkContext.applicationId, t.dir, name)
    if key not in _BUILT:
        _BUILT[key] = build(scratch.new_path(t.spark, name))
    return _BUILT[key]


scratch.on_clean(_BUILT.clear)

BM25 = """WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\W+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(ws)) AS words FROM w),
p AS (SELECT id, len(ws) AS size, word, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS word FROM w) WHERE word IN ('the', 'license', 'und', 'mail') GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM p GROUP BY 1)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (words / n)))), 6) AS score FROM p JOIN d USING (word), s GROUP BY id"""


def _texts(t: Tables) -> TextIndex:
    def build(path):
        """The corpus in two batches, as it would come in."""
        index, docs = TextIndex(t.spark, path), t.table("documents")
        index.add(docs.where("doc_id % 3 <> 0"))
        index.add(docs.where("doc_id % 3 = 0"))
        return index

    return _index(t, "texts", build)


@query(BM25)
def ranked_text_search(t: Tables):
    return _texts(t).search("The license, und MAIL").select("id", F.round("score", 6).alias("score"))


@query(BM25.replace("AS score FROM p JOIN d", "AS score, count(*) AS words FROM p JOIN d").replace("GROUP BY id", "GROUP BY id ORDER BY score DESC, id LIMIT 20").replace(", count(*) AS words", ""))
def ranked_text_top(t: Tables):
    return _texts(t).search("the license und mail").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20)


def _names(t: Tables) -> TrigramIndex:
    return _index(t, "trigrams", lambda path: TrigramIndex.build(t.nodes(), ("name", "path", "file_path"), path))


@query("SELECT id, name, label FROM nodes WHERE contains(lower(name), 'dget') OR contains(lower(path), 'dget') OR contains(lower(file_path), 'dget')", "nodes")
def search_by_trigrams(t: Tables):
    return _names(t).search("DGET", ("name", "path", "file_path")).select("id", "name", "label")


@query("SELECT id, name FROM nodes WHERE contains(name, 'ER0')  OR contains(name, 'ed ')", "nodes")
def search_by_trigrams_case(t: Tables):
    index = _names(t)
    return index.search("ER0", ("name",), case=True).unionByName(index.search("ed ", ("name",), case=True)).select("id", "name").distinct()


def _pages(t: Tables) -> PageIndex:
    return _index(t, "pages", lambda path: PageIndex.build(t.nodes(), path, size=1000))


def _page_sql(page: str, limit: int, where: str = "true") -> str:
    return f"SELECT id, label, n FROM (SELECT id, label, row_number() OVER (ORDER BY CASE WHEN label = 'File' THEN path ELSE name END, id) - 1 AS n, count(*) OVER () AS total FROM nodes WHERE {where}) WHERE n >= {limit} * ({page}) AND n < {limit} * ({page} + 1)"


@query(_page_sql("0", 50), "nodes")
def page_first(t: Tables):
    return _pages(t).page(1, 50).select("id", "label", F.col("number").alias("n"))


@query(_page_sql("total // 2 // 100", 100), "nodes")
def page_middle(t: Tables):
    total = t.nodes().count()
    return _pages(t).page(total // 2 // 100 + 1, 100).select("id", "label", F.col("number").alias("n"))


@query(_page_sql("(total - 1) // 30", 30), "nodes")
def page_last(t: Tables):
    total = t.nodes().count()
    return _pages(t).page((total - 1) // 30 + 1, 30).select("id", "label", F.col("number").alias("n"))


@query(_page_sql("1", 40, "label = 'Function'"), "nodes")
def page_of_label(t: Tables):
    index = _index(t, "label_pages", lambda path: PageIndex.build(t.nodes(), path, by="label", size=700))
    return index.page(2, 40, "Function").select("id", "label", (F.col("number") - index.groups["Function"][0]).alias("n"))

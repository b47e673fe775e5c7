"""Stored indexes, so that a search or a page reads what it needs and not every row.

``TextIndex`` ranks texts by words (BM25) over segments of postings; an added batch writes a segment of its own, and
``merge`` makes one of all. ``TrigramIndex`` finds substrings: the term's runs of three letters name lists of ids, what
is in all lists is verified. ``PageIndex`` keeps rows in order with their numbers, in blocks; a page of any depth reads
one block or two. Lists lie in folders by a checksum of their key, pages in folders by block, so other folders aren't
opened. Folders should be in a store that executors share.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import scratch
from .graph import sort_key
from .numbering import numbered

BUCKETS = 64
K1, B = 1.2, 0.75


def folded_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), "")


def _bucket(key: Column) -> Column:
    return (F.crc32(key.cast("binary")) % BUCKETS).cast("int")


def _buckets(keys: Sequence[str]) -> list[int]:
    return sorted({zlib.crc32(k.encode()) % BUCKETS for k in keys})


class TextIndex:
    """Postings (word, id, tf, size of the text) in segments. A segment counts once its record is written, which names the
    segments that it replaces; what a failed attempt left is never read. Ids must be new to the index; null ids are left
    out, and empty texts count as texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[dict]:
        """Records of the segments that count: one for each batch since the last merge."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        all_ = [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/records").collect()]
        gone = {x for r in all_ for x in r["replaces"]}
        return sorted((r for r in all_ if r["segment"] not in gone), key=lambda r: r["segment"])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Index a batch; returns its record."""
        words = folded_words(F.col(text_col))
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("w"))
        rows_in_order = rows.select("id", F.sort_array("w").alias("w"))
        starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda k: (k == 1) | (F.element_at("w", k) != F.element_at("w", F.greatest(k - 1, F.lit(1)))))
        counted = rows_in_order.where(F.size("w") > 0).select("id", "w", F.size("w").alias("size"), starts.alias("at"))  # a text's words are counted in its row
        each = F.transform("at", lambda k, i: F.struct(F.element_at("w", k).alias("word"), (F.coalesce(F.get("at", i + 1), F.col("size") + 1) - k).alias("tf")))
        postings = counted.select("id", "size", F.explode(each).alias("x")).select("x.word", "id", "size", "x.tf")
        return self._write(postings, *rows.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0))).first(), [])

    def merge(self) -> dict:
        """One segment in place of all."""
        old = self.segments()
        rows = self._postings(old).select("word", "id", "size", "tf")
        return self._write(rows, sum(r["docs"] for r in old), sum(r["words"] for r in old), [r["segment"] for r in old])

    def _write(self, postings: DataFrame, docs: int, words: int, replaces: list[str]) -> dict:
        record = {"segment": uuid.uuid4().hex[:12], "docs": docs, "words": words, "replaces": replaces}
        rows = postings.withColumn("bucket", _bucket(F.col("word"))).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "word").sortWithinPartitions("bucket", "word", "id")
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/segment={record['segment']}")
        scratch.write_text(self.spark, f"{self.path}/records/{record['segment']}.json", json.dumps(record))
        return record

    def _postings(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema("word string, id long, size int, tf int, segment string, bucket int").option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/segment={r['segment']}" for r in segments])

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """(id, score) of the texts with any word of the query; the best first if limited."""
        wanted, segments = sorted({w for w in re.split(r"\W+", query.lower()) if w}), self.segments()
        if not wanted or not segments:
            return self.spark.createDataFrame([], "id long, score double")
        docs, words = sum(r["docs"] for r in segments), sum(r["words"] for r in segments)
        hits = self._postings(segments).where(F.col("bucket").isin(_buckets(wanted)) & F.col("word").isin(wanted))
        hits = hits.groupBy("word", "id", "size").agg(F.sum("tf").alias("tf"))
        df = hits.groupBy("word").agg(F.count("*").alias("df"))  # a row for each word of the query
        idf = F.ln(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (words / max(docs, 1))))
        out = hits.join(F.broadcast(df), "word").groupBy("id").agg(F.sum(part).alias("score"))
        return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the folded text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) > 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    """Lists of the ids of the rows whose columns have a trigram, and the rows themselves by a checksum of their ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, columns: Sequence[str], path: str) -> TrigramIndex:
        """Index string columns of rows that have an id."""
        lists = rows.where("id is not null").select("id", F.explode(F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in columns])))).alias("gram"))
        lists = lists.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", "gram").sortWithinPartitions("bucket", "gram", "id")
        lists.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/lists")
        stored = rows.where("id is not null").withColumn("home", _bucket(F.col("id").cast("string"))).repartition("home").sortWithinPartitions("home", "id")
        stored.write.option("compression", "zstd").partitionBy("home").parquet(f"{path}/rows")
        return cls(rows.sparkSession, path)

    def lists(self, term: str) -> DataFrame:
        """(id, gram) of the term's trigrams."""
        grams = sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})
        return self.spark.read.parquet(f"{self.path}/lists").where(F.col("bucket").isin(_buckets(grams)) & F.col("gram").isin(grams))

    def search(self, term: str, columns: Sequence[str], case: bool = False) -> DataFrame:
        """The rows with the term in one of the columns; a term of one or two letters needs a scan."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        hit = lambda c: F.col(c).contains(term) if case else F.lower(c).contains(term.lower())
        where = F.coalesce(F.greatest(*[F.coalesce(hit(c), F.lit(False)) for c in columns], F.lit(False)), F.lit(False))
        if len(term) > 2:
            n = len({term.lower()[i : i + 3] for i in range(len(term) - 2)})
            some = self.lists(term).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("id", _bucket(F.col("id").cast("string")).alias("home"))
            rows = rows.join(some, ["home", "id"], "left_semi")
        return rows.where(where).drop("home")


class PageIndex:
    """Rows in order with their numbers, in blocks of ``size`` rows; by group if there is one."""

    def __init__(self, spark: SparkSession, path: str, size: int, groups: dict | None):
        self.spark, self.path, self.size, self.groups = spark, path, size, groups

    @classmethod
    def build(cls, nodes: DataFrame, path: str, by: str | None = None, size: int = 100_000) -> PageIndex:
        """Nodes by their page order (a file's path, else the name, then the id); ``by``: a column of few values, whose
        pages are numbered apart."""
        rows = numbered(nodes.withColumn("_key", sort_key()), *([by] if by else []), "_key", "id").drop("_key")
        rows = rows.withColumn("block", (F.col("number") / size).cast("long"))
        rows.repartition("block").sortWithinPartitions("number").write.option("compression", "zstd").partitionBy("block").parquet(path)
        groups = None
        if by:
            stored = nodes.sparkSession.read.parquet(path)
            groups = {r[0]: (r[1], r[2]) for r in stored.groupBy(by).agg(F.min("number"), F.count("*")).collect()}
        return cls(nodes.sparkSession, path, size, groups)

    def page(self, page: int = 1, limit: int = 50, group: str | None = None) -> DataFrame:
        """The rows of a page, in order of ``number``."""
        page, limit = max(1, page), min(max(1, limit), 100)
        first, most = (0, None) if self.groups is None else self.groups.get(group, (0, 0))
        lo = first + (page - 1) * limit
        hi = lo + limit if most is None else min(lo + limit, first + most)
        blocks = list(range(lo // self.size, max(hi - 1, lo) // self.size + 1))  # two at most, as a page is shorter than a block
        rows = self.spark.read.parquet(self.path).where(F.col("block").isin(blocks) & (F.col("number") >= lo) & (F.col("number") < hi))
        return rows.drop("block").orderBy("number")

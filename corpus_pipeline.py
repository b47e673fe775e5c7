"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

Quality rules drop documents, line dedup shortens texts (documents left without any line go), the Jaccard join keeps
one document of each group of near copies, decontamination drops documents with benchmark passages, and packing turns
what is left into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcweave.llm.decontamination import decontaminate
from srcweave.llm.jaccard_join import jaccard_dedup
from srcweave.llm.line_dedup import line_dedup
from srcweave.llm.packing import pack_sequences
from srcweave.llm.quality_rules import quality_rules, trusted_ids
from srcweave.plans import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MORE = COLUMNS[2:]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs.select(*COLUMNS), trusted_ids(spark, sf_dir)).where("rules.kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup(docs, keep=MORE).where("n_removed < n_lines or n_lines = 0")
    return done.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_dedup(docs, keep=MORE).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=MORE)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_sequences(docs, with_ids=False)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("packing", packing)]
ORACLE_SQL = None  # tokens can't be made in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else scratch.materialize(docs, f"stage{k}"), sf_dir)
    return docs

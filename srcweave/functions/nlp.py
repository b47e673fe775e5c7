"""Samples, importers and annotation checks. The annotator itself is a function that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Entity types.
ENTITY_TYPES = (
    "Person", "Project", "Task", "Decision", "Event", "Document", "Property", "Concept", "Belief", "Goal", "Preference",
    "Problem", "Solution", "Workflow", "Agreement", "Constraint", "Resource", "Metric", "Message", "Conversation",
    "Location", "Market", "Sentiment", "Concern", "Lesson", "Assumption", "Organization", "CodeEntity",
)
#: Relationship types.
RELATIONSHIP_TYPES = (
    "OWNS", "CREATED", "PART_OF", "CONTAINS", "KNOWS", "WORKS_FOR", "RECOMMENDED", "SENT", "RECEIVED", "PARTICIPATED_IN",
    "DISCUSSED", "DECIDED", "LED_TO", "SUPPORTS", "CONTRADICTS", "ASSUMES", "SOLVES", "CAUSED_BY", "AFFECTED_BY",
    "DEPENDS_ON", "BLOCKS", "ENABLES", "FOLLOWS", "PRECEDES", "SCHEDULED_FOR", "EVOLVED_FROM", "SUPERSEDES",
    "LEARNED_FROM", "LOCATED_AT", "IN_MARKET", "PARTY_TO", "GOVERNS", "DOCUMENTED_IN", "CONSTRAINS", "IMPOSED_BY",
    "ACHIEVES", "PRIORITIZES", "ALIGNS_WITH", "REQUIRES", "CONSUMES", "FEELS_ABOUT", "RAISED", "CONCERNS", "TRIGGERS",
    "STEP_IN", "RELATED_TO", "APPLIES", "MENTIONED_IN", "MEASURES", "COMPARED_TO",
)
CONFIDENCE = 0.9
BATCH = 10
SAMPLE = "id string, text string, source string, created_at string, metadata map<string,string>"
ENTITY = "sample_id string, text string, type string, start int, end int, confidence double"


def samples(texts: DataFrame, source: str = "text", created_at: str | None = None) -> DataFrame:
    """Samples of rows (text): trimmed, empty ones dropped; the id is a digest, so the same text has the same id."""
    t = F.trim("text")
    at = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = texts.select(t.alias("text")).where(F.length("text") > 0)
    return out.select(F.substring(F.sha2("text", 256), 1, 32).alias("id"), "text", F.lit(source).alias("source"), at.alias("created_at"), F.create_map().cast("map<string,string>").alias("metadata"))


def from_strings(spark: SparkSession, texts: list[str], **kw) -> DataFrame:
    return samples(spark.createDataFrame([(x,) for x in texts], "text string"), **kw)


def from_json_array(spark: SparkSession, path: str, field: str = "text", source: str = "json", created_at: str | None = None) -> DataFrame:
    """Objects of one JSON array; the whole object is kept as metadata."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.trim(F.col(field).cast("string")).alias("text"), F.to_json(F.struct("*")).alias("object")).where("length(text) > 0")
    return rows.select(F.substring(F.sha2("text", 256), 1, 32).alias("id"), "text", F.lit(source).alias("source"), F.lit(created_at).alias("created_at"), F.create_map(F.lit("object"), "object").alias("metadata"))


def from_chat(messages: DataFrame, least: int = 10) -> DataFrame:
    """Messages (conversation, sender, text) of more than ``least`` characters when trimmed."""
    return messages.withColumn("text", F.trim("text")).where(F.length("text") > least)


def filter_samples(rows: DataFrame, least: int = 50, sender: str | None = None, key: str | None = None, value: str | None = None) -> DataFrame:
    out = rows.where(F.length("text") >= least)
    if sender:
        out = out.where(F.col("sender") == sender)
    return out.where(F.element_at("metadata", key) == value) if key else out


def valid_entities(found: DataFrame) -> DataFrame:
    """Entities (sample_id, sample_text, text, type) of known types that occur in the sample's text, with the offsets
    of the first occurrence."""
    at = F.expr("locate(text, sample_text)")
    ok = found.where(F.col("type").isin(*ENTITY_TYPES)).withColumn("start", at - 1).where("start >= 0")
    return ok.withColumn("end", F.col("start") + F.length("text")).withColumn("confidence", F.lit(CONFIDENCE))


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (sample_id, head, tail, ..) with the ids of the first entities of these texts; others are dropped."""
    first = entities.groupBy("sample_id", "text").agg(F.min("id").alias("_id"))
    h = first.select("sample_id", F.col("text").alias("head"), F.col("_id").alias("head_id"))
    t = first.select("sample_id", F.col("text").alias("tail"), F.col("_id").alias("tail_id"))
    return relations.join(h, ["sample_id", "head"]).join(t, ["sample_id", "tail"])


def valid_relations(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("type").isin(*RELATIONSHIP_TYPES)).withColumn("confidence", F.lit(CONFIDENCE))


def annotate(rows: DataFrame, annotator: Callable[[list[str]], list[list[dict]]], batch: int = BATCH) -> DataFrame:
    """Entities of each sample by batches of ``batch`` texts; a batch that fails is left out, the job goes on.

    annotator: texts to, for each, a list of {text, type}. Known types only, offsets by first occurrence.
    """

    def run(it: Iterator):
        import pandas as pd

        for pdf in it:
            out = []
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                try:
                    found = annotator(part["text"].tolist())
                except Exception:  # whatever the model raised: the batch is skipped
                    continue
                for i, t, es in zip(part["id"], part["text"], found, strict=True):
                    out += [(i, t, str(e.get("text", "")), str(e.get("type", ""))) for e in es]
            yield pd.DataFrame(out, columns=["sample_id", "sample_text", "text", "type"])

    found = rows.select("id", "text").mapInPandas(run, "sample_id string, sample_text string, text string, type string")
    return valid_entities(found)

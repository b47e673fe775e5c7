"""Source trees as rows (path, content)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import values as V
from ..operators.changes import content_hash

#: Endings of source files by language, and paths left out.
TYPESCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
PYTHON = (".py", ".pyw", ".pyi")
CSHARP = (".cs",)
IGNORED = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**", "**/*.test.ts", "**/*.test.tsx",
    "**/*.spec.ts", "**/*.spec.tsx", "**/__tests__/**", "**/__mocks__/**", "**/.next/**", "**/.turbo/**",
    "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/*.pyc",
)


def scan(spark: SparkSession, root: str, endings: Sequence[str] = TYPESCRIPT + PYTHON + CSHARP, ignored: Sequence[str] = IGNORED, limit: int | None = None) -> DataFrame:
    """(path, content, modified) of the files below root with one of the endings, but for the ignored ones.

    A pattern ``**/x/**`` leaves out paths with the directory x, ``**/*y`` those that end in y. limit takes the
    first by path.
    """
    globs = "{" + ",".join(f"*{e}" for e in endings) + "}"  # by name, so that nothing else is listed as input or read
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = raw.select(path.alias("path"), F.col("modificationTime").alias("modified"), F.col("content").alias("_bytes"))
    ok = F.lit(False)
    for e in endings:
        ok = ok | F.col("path").endswith(e)
    for g in ignored:
        body = g.replace("**/", "")
        ok = ok & (~F.col("path").contains("/" + body.removesuffix("/**") + "/") if body.endswith("/**") else ~F.col("path").endswith(body.replace("*", "")))
    rows = rows.where(ok)
    if limit:
        rows = rows.orderBy("path").limit(limit)
    return rows.select("path", F.decode("_bytes", "UTF-8").alias("content"), "modified")


def analytics_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, (".ts", ".tsx"), IGNORED, 200)


def vulnerability_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, (".ts", ".tsx", ".js", ".jsx"), IGNORED, 100)


def file_rows(files: DataFrame) -> DataFrame:
    """File nodes: name, extension, number of lines, time of change, hash."""
    p = F.col("path")
    return files.select("path", V.basename(p).alias("name"), V.extension(p).alias("extension"), V.loc(F.col("content")).alias("loc"), V.iso(F.col("modified")).alias("last_modified"), content_hash(F.col("content")).alias("hash"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that don't parse, and blank ones, are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_messages(spark: SparkSession, path: str, source: str = "jsonl") -> DataFrame:
    """(text, source, ..) of a JSON-lines file of messages; rows without a text are dropped."""
    rows = read_jsonl(spark, path, "id string, text string, source string, sender string, created_at string")
    return rows.where("text is not null").withColumn("source", F.coalesce("source", F.lit(source)))


def read_chats(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Messages of exported conversations (uuid, name, chat_messages)."""
    from ..functions.nlp import from_chat

    schema = "uuid string, name string, created_at string, chat_messages array<struct<uuid:string,text:string,sender:string,created_at:string>>"
    chats = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = chats.select(F.col("uuid").alias("conversation"), "name", F.explode("chat_messages").alias("m"))
    return from_chat(rows.select("conversation", "name", F.col("m.uuid").alias("id"), F.col("m.text").alias("text"), F.col("m.sender").alias("sender"), F.col("m.created_at").alias("created_at")), least)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def extract_rows(files: DataFrame, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(path relative to root, hash: md5, kind, name) of files (path, content) and of the functions, classes and interfaces in them.

    include and exclude are patterns with ``*`` on the relative path; without any, all are taken.
    """
    from ..operators.ingest import extract

    rel = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    fits = lambda patterns: reduce(Column.__or__, [F.col("_rel").like(g.replace("_", "\\_").replace("*", "%")) for g in patterns], F.lit(False))
    some = files.withColumn("_rel", rel).where((fits(include) if include else F.lit(True)) & ~fits(exclude))
    found = extract(some).where("kind in ('Function', 'Class', 'Interface')").select("path", "kind", F.get_json_object("row", "$.name").alias("name"))
    own = some.select("path", F.lit("File").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name")).unionAll(found)
    return own.join(some.select("path", F.col("_rel"), F.md5("content").alias("hash")), "path").select(F.col("_rel").alias("path"), "hash", "kind", "name")


def as_table(rows: DataFrame, limit: int = 1000) -> str:
    """The first rows as text in columns, under the columns' names."""
    got = [[str(x) for x in rows.columns], *[["" if v is None else str(v) for v in r] for r in rows.limit(limit).collect()]]
    width = [max(len(r[k]) for r in got) for k in range(len(rows.columns))]
    show = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([show(got[0]), " | ".join("-" * w for w in width), *map(show, got[1:])])


def write_result(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A query's result as json or csv (with a header, every value quoted)."""
    w = rows.write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).option("quoteAll", True).csv(path)

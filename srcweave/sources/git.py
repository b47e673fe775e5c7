"""Commit history: rows read on the driver from a repository's log, and the sync as joins.

``git log`` runs outside Spark and is bounded by ``most`` commits a sync; everything after it is a DataFrame.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.upsert import upsert

COMMIT = "hash string, message string, author string, email string, date string, ord int"
CHANGE = "hash string, path string, lines_added int, lines_removed int"


def log(spark: SparkSession, repository: str, since: str | None = None, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(commits, oldest first; changes) after the commit ``since``, at most ``most`` of them."""
    span = [f"{since}..HEAD"] if since else ["HEAD"]
    text = subprocess.run(
        ["git", "-C", repository, "log", "--reverse", "--numstat", "--no-renames", "--date=iso-strict", "--pretty=format:%x1e%H%x1f%s%x1f%an%x1f%ae%x1f%ad", *span],
        capture_output=True, text=True, check=True,
    ).stdout
    commits, changes = [], []
    for k, entry in enumerate([e for e in text.split("\x1e") if e.strip()][:most]):
        head, *rows = entry.strip("\n").split("\n")
        h, message, author, email, date = head.split("\x1f")
        commits.append((h, message, author, email, date, k))
        for r in rows:
            parts = r.split("\t")
            if len(parts) == 3:
                added, removed = (int(x) if x.isdigit() else None for x in parts[:2])
                changes.append((h, parts[2], added, removed))
    return spark.createDataFrame(commits, COMMIT), spark.createDataFrame(changes, CHANGE)


def info(repository: str) -> dict:
    def run(*a: str) -> str:
        return subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, check=False).stdout.strip()

    return {"branch": run("rev-parse", "--abbrev-ref", "HEAD"), "remote": run("config", "--get", "remote.origin.url") or None, "last_commit": run("rev-parse", "HEAD"), "commits": int(run("rev-list", "--count", "HEAD") or 0)}


def sync(metadata: DataFrame, commits: DataFrame, changes: DataFrame, files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits kept, MODIFIED_IN, metadata with the new cursor): both ends of an edge must exist."""
    kept = upsert(stored, commits.select("hash", "message", "author", "email", "date", F.col("ord").alias("seq")), ["hash"])
    edges = changes.join(kept.select("hash"), "hash", "left_semi").join(files.select("path"), "path", "left_semi")
    edges = edges.select(F.concat(F.lit("File:"), "path").alias("src"), F.concat(F.lit("Commit:"), "hash").alias("dst"), "lines_added", "lines_removed")
    last = commits.agg(F.max_by("hash", "ord").alias("value")).where("value is not null").select(F.lit("lastCommitSynced").alias("key"), "value", F.lit(1).alias("seq"))
    return kept, edges, upsert(metadata, last, ["key"])

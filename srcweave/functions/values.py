"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Names for languages of code blocks.
LANGUAGE_ALIASES = {
    "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "py": "python", "rb": "ruby",
    "sh": "bash", "shell": "bash", "zsh": "bash", "yml": "yaml", "dockerfile": "docker",
}
#: What a shell command has in it.
SHELL_WORDS = ("npm ", "pnpm ", "yarn ", "bun ", "curl ", "git ")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def loc(content: Column) -> Column:
    """Number of lines, the empty one after a final line feed included."""
    return F.size(F.split(content, "\n", -1))


def slice_lines(files: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first..last (from 1, clamped) of ``content``: (.., number, line)."""
    lines = F.split("content", "\n", -1)
    picked = F.slice(lines, F.lit(max(1, first)), F.lit(max(0, last - max(1, first) + 1)))
    others = [c for c in files.columns if c != "content"]
    return files.select(*others, F.posexplode(picked).alias("_k", "line")).withColumn("number", F.col("_k") + max(1, first)).drop("_k")


def source_slice(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """(number, line) of a file of (path, content); a pseudo-file ``external:<name>`` gives a stub of two lines."""
    if path.startswith("external:"):
        stub = [(1, f"// External module: {path.removeprefix('external:')}"), (2, "// Its source is not part of the project")]
        return files.sparkSession.createDataFrame(stub, "number int, line string")
    return slice_lines(files.where(F.col("path") == path).select("content"), first, last).select("number", "line")


def normalize_language(c: Column) -> Column:
    low = F.lower(F.trim(c))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    return F.when(c.isNotNull() & (low != ""), F.coalesce(names[low], low))


def is_shell(language: Column, content: Column) -> Column:
    t = F.trim(content)
    out = F.coalesce(normalize_language(language) == "bash", F.lit(False)) | t.startswith("$") | t.startswith("#")
    for w in SHELL_WORDS:
        out = out | t.contains(w)
    return out


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def index_of(c: Column, part: str) -> Column:
    """0-based place of a part, -1 without."""
    return F.instr(c, part) - 1


def clean_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9:_-]", "_")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def days_until(ts: Column, now: str) -> Column:
    return F.floor((F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(ts)) / 86400)


def is_private(name: Column) -> Column:
    return name.startswith("_")


def is_interface_name(name: Column) -> Column:
    """``I`` and another capital, by which C# names interfaces."""
    return name.rlike("^I[A-Z]")


def is_component_name(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path has the fixed part of one of the patterns: ``**/x/**`` asks for x."""
    out = F.lit(False)
    for g in globs:
        part = g.replace("**/", "").replace("/**", "").replace("*", "")
        if part:
            out = out | path.contains(part)
    return out

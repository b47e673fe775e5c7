"""Column helpers for operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside nested lambdas a plain expression would run per element."""
    return F.transform(F.array(value), body)[0]


def free(name: str, taken: list[str]) -> str:
    """The name, or with as many underscores after it as it takes to differ from all others (case doesn't count)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def set_aside(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` where a column that has this name already is called by a free one."""
    return docs.withColumnsRenamed({c: free(name, [name, *docs.columns]) for c in docs.columns if c.lower() == name.lower()})


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def fold(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the folded text; a null text has none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def span(first: Column, last: Column) -> Column:
    """first .. last, empty if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

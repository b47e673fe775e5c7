"""License scans, built of DataFrame functions only: phrases, and an exact set-similarity join with templates.

Method: a text block is a window of as many consecutive words as the template has, across line ends, so it is bounded
from both sides; blocks and templates are word sets, and a block matches a template when it holds at least
``CONTAINMENT`` of the template's distinct words. Words are ordered by how often the whole corpus has them, rarest first.
A text with a matching block must hold a word of the template's prefix, its m - a + 1 rarest words, where a is the least
number of common words (prefix and positional filter: with only less rare words too few are left), and at least a of its
words in all (length filter). For the templates that are left every window is verified exactly, in one pass over the
places of the template's words that carries the last place of each, so time grows with the text, not with its matches.

Templates and phrases are parameters, by default the sets stated in this file, so they ride along as literals and the join runs inside each document's
row: nothing is shuffled but the counts of the templates' few words. Documents without any prefix word leave early.

Cases: a null or empty text has no words, places or labels and score 0; repeated rows get a result each; an empty
table gives an empty result. Only the text column is read and all columns are handed on; one that is called ``license``
already is called ``license_`` afterwards (``license__`` if that is there too). Phrases may have any number of words.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .native import alnum_words, let, set_aside, span

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Fixed values: (label, template) of usual license lines.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)
CONTAINMENT = 0.9
Templates = Sequence[tuple[str, str]]


def _places(w: Column, phrase: str) -> Column:
    """0-based starts of the phrase's words."""
    words = phrase.split()
    same = lambda i: reduce(Column.__and__, [F.element_at(w, i + k) == F.lit(x) for k, x in enumerate(words)])
    found = F.filter(span(F.lit(1), F.size(w) - len(words) + 1), same)
    return F.when(F.array_contains(w, words[0]) & F.array_contains(w, words[-1]), F.transform(found, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def word_counts(docs: DataFrame, text_col: str = "text", templates: Templates = TEMPLATES) -> dict[str, int]:
    """How often the corpus has each word of the templates (a bounded set)."""
    vocabulary = sorted({x for _, t in templates for x in t.split()})
    found = docs.select(F.explode(F.filter(alnum_words(F.col(text_col)), lambda x: x.isin(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def _index(counts: dict[str, int], texts: Templates) -> tuple[list[str], list[tuple[str, list[int], int, int]]]:
    """Words in order, rarest first, and for each template (label, ranks in order, least number of common words, words)."""
    order = sorted({x for _, t in texts for x in t.split()}, key=lambda x: (counts.get(x, 0), x))
    rank = {x: i + 1 for i, x in enumerate(order)}
    return order, [(label, sorted({rank[x] for x in t.split()}), math.ceil(CONTAINMENT * len(set(t.split()))), len(t.split())) for label, t in texts]


def _matches(w: Column, order: list[str], templates: list[tuple[str, list[int], int, int]]) -> Column:
    """array<struct(label, share)> of the templates that some window of the text holds."""
    words = F.array(*map(F.lit, order))
    index = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, r)).alias("ranks"), F.lit(a).alias("least"), F.lit(k).alias("size")) for label, r, a, k in templates])
    prefix = sorted({order[k - 1] for _, r, a, _ in templates for k in r[: len(r) - a + 1]})
    none = F.array().cast("array<struct<label:string,share:double>>")

    def passes(t: Column, present: Column) -> Column:
        """A word of the template's prefix, and as many of its words as it takes, somewhere in the text."""
        m = F.size(t["ranks"])
        return F.arrays_overlap(F.slice(t["ranks"], 1, m - t["least"] + 1), present) & (F.size(F.array_intersect(t["ranks"], present)) >= t["least"])

    def most(t: Column, places: Column) -> Column:
        """The most distinct words of the template in any window: the last place of each of its words is carried along."""
        m = F.size(t["ranks"])
        start = F.struct(F.array_repeat(-t["size"], m).alias("last"), F.lit(0).alias("best"))

        def step(s: Column, x: Column) -> Column:
            at = F.array_position(t["ranks"], x["r"])
            last = F.transform(s["last"], lambda p, j: F.when(j + 1 == at, x["i"]).otherwise(p))
            return let(last, lambda p: F.struct(p.alias("last"), F.greatest(s["best"], F.size(F.filter(p, lambda q: q > x["i"] - t["size"]))).alias("best")))

        own = F.filter(places, lambda x: F.array_contains(t["ranks"], x["r"]))
        return F.aggregate(own, start, step, lambda s: s["best"])

    def of(places: Column) -> Column:
        def some(present: Column) -> Column:
            told = F.transform(F.filter(index, lambda t: passes(t, present)), lambda t: F.struct(t["label"].alias("label"), most(t, places).alias("common"), t["least"].alias("least"), F.size(t["ranks"]).alias("m")))
            return F.transform(F.filter(told, lambda x: x["common"] >= x["least"]), lambda x: F.struct(x["label"].alias("label"), (x["common"] / x["m"]).alias("share")))

        return let(F.array_distinct(F.transform(places, lambda x: x["r"])), some)

    places = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), F.array_position(words, x).cast("int").alias("r"))), lambda x: x["r"] > 0)
    return F.when(F.exists(w, lambda x: x.isin(prefix)), let(places, of)).otherwise(none)


def license_scan(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, str] = PHRASES, texts: Templates = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` and a struct ``license``: n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    phrases: labels by phrase; texts: (label, template). Both in words of lower-case letters and digits.
    """
    order, templates = _index(word_counts(docs, text_col, texts), texts)
    found = set_aside(docs, "license")
    text_col = found.columns[[c.lower() for c in docs.columns].index(text_col.lower())]

    def of(w: Column) -> Column:
        places = F.struct(*[_places(w, p).alias(f"p{i}") for i, p in enumerate(phrases)], _matches(w, order, templates).alias("found"), F.size(w).alias("n"))

        def collect(x: Column) -> Column:
            starts = F.concat(*[x[f"p{i}"] for i in range(len(phrases))])
            base = F.array_compact(F.array(*[F.when(F.size(x[f"p{i}"]) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
            share = F.array_max(F.transform(x["found"], lambda y: y["share"]))
            return F.struct(
                x["n"].cast("long").alias("n_words"),
                F.size(starts).cast("long").alias("n_base"),
                F.array_min(starts).cast("long").alias("first_word"),
                F.array_max(starts).cast("long").alias("last_word"),
                F.array_sort(F.array_distinct(base)).alias("base_labels"),
                F.array_sort(F.array_union(base, F.transform(x["found"], lambda y: y["label"]))).alias("labels"),
                F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
            )

        return let(places, collect)

    return found.withColumn("license", let(alnum_words(F.col(text_col)), of))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    x = F.col("license")
    return found.select(
        "doc_id", x["n_words"].alias("n_words"), x["n_base"].alias("n_base"), x["first_word"].alias("first_word"), x["last_word"].alias("last_word"),
        F.array_join(x["base_labels"], ",").alias("base_labels"), F.array_join(x["labels"], ",").alias("labels"), x["score"].alias("score"),
    )

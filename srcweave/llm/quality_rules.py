"""Quality rules, built of DataFrame functions only.

Method: hashed n-grams (word unigrams, and bigrams of word endings) of the whole corpus give a raw multinomial, those
of trusted documents a target multinomial, both over ``BUCKETS`` buckets. A document's score is the mean
log-likelihood ratio of its n-grams, target against raw, so it doesn't depend on length; below ``THRESHOLD`` it is
rejected. The target's multinomial is smoothed towards the raw one by ``PRIOR`` pseudo-counts, so a bucket on which
the trusted documents say little weighs nothing. Before that come fixed rules: fewer than ten words, or more than a
fifth of the words in repeated five-word windows.

Corpus counts cover every document: n-grams are exploded and counted map-side, so each task sends at most BUCKETS
rows. The target counts cover every trusted document: documents are joined with all trusted ids, which shuffles the
texts once; rows without an id are spread by their texts. The weights, BUCKETS doubles, reach the tasks as a scalar
subquery; a score needs no join or shuffle.

Cases: a null or empty text has zero counts and fails the base rules; repeated rows are counted and returned each;
an empty table gives an empty result; with no trusted documents every weight is 0 and only the base rules decide.
Only the id and text columns are read and all columns are handed on; one that is called ``rules`` already is called
``rules_`` afterwards (``rules__`` if that is there too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .native import blank_words, free, let, set_aside

BUCKETS = 1 << 16
PRIOR = 20_000.0
THRESHOLD = -0.2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _end(word: Column) -> Column:
    return F.substring(word, -3, 3)


def _ahead(a: Column, k: int) -> Column:
    """The array from its k+1st member on."""
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def _repeat_words(h: Column) -> Column:
    """Words in five-word windows that are found twice or more, from the words' hashes."""

    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        same = lambda k: F.element_at(sorted_, k)["h"]
        hits = F.filter(F.sequence(F.lit(1), n), lambda k: ((k > 1) & (same(k) == same(F.greatest(k - 1, F.lit(1))))) | ((k < n) & (same(k) == same(F.least(k + 1, n)))))
        places = F.array_sort(F.transform(hits, lambda k: F.element_at(sorted_, k)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def windows(w: Column) -> Column:
        return F.when(
            F.size(F.array_distinct(w)) < F.size(w),
            let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered),
        ).otherwise(F.lit(0))

    # hashes of two words, of four, of five: each from hashes that are there, so no window's words are gathered
    two = lambda a: F.zip_with(a, _ahead(a, 1), lambda x, y: F.xxhash64(x, y))
    four = let(two(h), lambda a: F.zip_with(a, _ahead(a, 2), lambda x, y: F.xxhash64(x, y)))
    five = F.slice(F.zip_with(four, _ahead(h, 4), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.size(h) - 4, F.lit(0)))
    return F.when(F.size(h) >= 6, let(five, windows)).otherwise(F.lit(0))


def base_counts(text: Column, weights: Column | None = None) -> Column:
    """A struct of the base rules' counts, and with weights the score, of one text."""
    t = F.coalesce(text, F.lit(""))
    seen = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of(x: Column) -> Column:
        w, h = x["w"], x["h"]
        fields = [
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            seen.cast("long").alias("n_dup_lines"),
            _repeat_words(h).cast("long").alias("n_repeat_words"),
        ]
        if weights is not None:
            one = F.aggregate(h, F.lit(0.0), lambda a, b: a + F.element_at(weights, F.pmod(b, F.lit(BUCKETS)).cast("int") + 1))
            pairs = let(F.transform(w, _end), lambda e: F.zip_with(e, _ahead(e, 1), lambda a, b: F.element_at(weights, _bucket(a, b) + 1)))
            total = one + F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)
            fields.append(F.when(F.size(w) > 0, total / (2 * F.size(w))).otherwise(F.lit(0.0)).alias("score"))
        return F.struct(*fields)

    return let(let(blank_words(text), lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"))), of)


def ratio_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (weights array<double>): each bucket's log-likelihood ratio. trusted: one column of ids."""
    ids = trusted.toDF("_id").where("_id is not null").distinct().select("_id", F.lit(0).cast("long").alias("_none"), F.lit(1).alias("_in"))
    text = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    text = text.withColumn("_salt", F.when(F.col("_key").isNull(), F.xxhash64("_text")).otherwise(F.lit(0)).cast("long"))
    marked = text.join(ids.hint("shuffle_hash"), (F.col("_key") == F.col("_id")) & (F.col("_salt") == F.col("_none")), "left")
    counts = grams(marked.select(F.coalesce("_in", F.lit(0)).alias("_in"), "_text"), "_text", "_in").groupBy("b").agg(F.count("*").alias("r"), F.sum("_in").alias("t"))
    packed = counts.agg(F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("c"))

    def weigh(c: Column) -> Column:
        total = lambda k: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[k])

        def of(z: Column) -> Column:
            p = lambda x: (x["r"] + 1) / (z["raw"] + BUCKETS)
            seen = F.transform(c, lambda x: F.struct(x["b"].alias("b"), F.log((x["t"] + PRIOR * p(x)) / (z["target"] + PRIOR) / p(x)).alias("w")))
            return F.when(z["target"] > 0, seen).otherwise(F.slice(seen, 1, 0))

        return let(F.struct(total("r").alias("raw"), total("t").alias("target")), of)

    sparse = packed.select(F.inline(let(F.col("c"), weigh)))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(sparse, "b", "left")
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("weights"))


def grams(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep, b): the bucket of each n-gram of every text, one row each; the last word makes a pair with nothing.

    Words become rows beside the words after them before anything is hashed, so hashing runs in generated code.
    """
    words = docs.select(*keep, blank_words(F.col(text_col)).alias("_w"))
    both = words.select(*keep, F.inline(F.arrays_zip(F.col("_w").alias("_a"), _ahead(F.col("_w"), 1).alias("_b"))))
    return both.select(*keep, F.explode(F.array(_bucket(F.col("_a")), _bucket(_end(F.col("_a")), _end(F.col("_b"))))).alias("b"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and a struct ``rules``: the counts, score, base_failed, kept."""
    weights = ratio_weights(docs, trusted, id_col, text_col).scalar()
    out, held = set_aside(docs, "rules"), free("_weights", docs.columns)
    text_col = out.columns[[c.lower() for c in docs.columns].index(text_col.lower())]

    def judged(r: Column) -> Column:
        failed = (r["n_words"] < 10) | (100 * r["n_repeat_words"] > 20 * r["n_words"])
        return F.struct(*[r[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & (r["score"] >= F.lit(threshold))).alias("kept"))

    # one expression for all of it: a filter on ``kept`` that is pushed below then computes it once
    rules = let(base_counts(F.col(text_col), F.col(held)), judged).alias("rules")
    return out.withColumn(held, weights).select(*out.columns, rules)


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, trusted_ids(spark, sf_dir)).select("doc_id", "rules.*")

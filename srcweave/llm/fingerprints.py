"""Document fingerprints by consistent weighted sampling, built of DataFrame functions only.

A document is a set of terms (its words) with weights (how often it has them). For each sample and term three numbers
are drawn from hashes of the term: r and c from the gamma distribution of shape 2, b from 0..1. With the weight S,
t = floor(ln S / r + b) names one of the steps of ln S, y = exp(r (t - b)) is the step's weight, and the term's rank is
a = c / (y exp(r)). The term and step of least rank are the sample: two documents draw the same with a probability equal
to the generalised Jaccard similarity of their weights, the sum of the smaller over the sum of the larger weights. As a
rank follows from term and step, ln a itself, as a 32-bit float, is the sample; ``SAMPLES`` of them as hex digits are the
fingerprint, and the share of equal samples of two fingerprints is their likeness (standard error sqrt(J (1 - J) / SAMPLES)).

The neighbour of each document, by descending id, is found on rows of ids alone: they are dealt by ranges, written, and
linked within ranges and, by one row for each range, across them. Texts are shuffled once by document and their heads
once to the document before; what follows keeps that partitioning. Words of the part that a text and its edited form
share are split and drawn once for both. Terms, not documents, are the rows of the heavy work, so neither a long text
nor a group of copies makes a task uneven beyond its size.

Cases: a null text is empty; an empty text has an empty fingerprint, which is as good as equal to another empty one (1)
and unlike any other (0); null ids come last; among equal ids rows are ordered by a hash of the text, and rows equal in id
and text are one document here whose result is repeated; a single document is its own neighbour; an empty table gives an
empty result. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import scratch

SAMPLES = 24
GROUP = 4  # samples drawn side by side: generated code of more grows too long to be compiled well
BLANK = r"[\x20\x09-\x0D]+"
KEY = ("k1", "k2")


def neighbours(rows: DataFrame) -> DataFrame:
    """For each (k1, k2, doc_id, n, copies), in descending order of doc_id and then of k2 and in a ring: the keys of the next and of the last one, and the last one's n."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k2")]
    dealt = scratch.materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")  # ranges come from a sample: written once
    own = F.struct("k1", "k2", "n")
    ends = dealt.groupBy("part").agg(F.min_by(own, F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"), "k2")).alias("head"), F.max_by(own, F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"), "k2")).alias("tail"))
    ring, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("head").over(ring), F.first("head").over(every)).alias("after"), F.coalesce(F.lag("tail").over(ring), F.last("tail").over(every)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order)
    linked = dealt.withColumns({"next": F.lead(own).over(inside), "last": F.lag(own).over(inside)}).join(F.broadcast(ends), "part")  # one row per range
    linked = linked.withColumns({"next": F.coalesce("next", "after"), "last": F.coalesce("last", "before")})
    return linked.select("k1", "k2", "doc_id", "n", "copies", F.col("next.k1").alias("next_k1"), F.col("next.k2").alias("next_k2"), F.col("last.k1").alias("last_k1"), F.col("last.k2").alias("last_k2"), (F.col("last.n") / 3).cast("long").alias("last_need"))


def _uniform(h: Column, shift: int) -> Column:
    """26 bits of a hash as a number between 0 and 1, ends excluded."""
    return (F.shiftright(h, shift).bitwiseAND(F.lit((1 << 26) - 1)) + F.lit(0.5)) * F.lit(2.0**-26)


def drawn(terms: DataFrame, weights: tuple[str, ...], samples: int = SAMPLES) -> DataFrame:
    """(k1, k2, and for each weight column an array of its samples, null where no term has weight) of rows (k1, k2, term: a hash, weights...)."""
    sides = range(len(weights))
    some = range(GROUP)
    rows = terms.select(*KEY, "term", *[F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))).alias(f"l{s}") for s, w in enumerate(weights)], F.explode(F.array(*map(F.lit, range(samples // GROUP)))).alias("g"))
    rows = rows.select(*KEY, "g", *[f"l{s}" for s in sides], *[F.xxhash64("term", "g", F.lit(2 * j + i)).alias(f"h{j}{i}") for j in some for i in (0, 1)])
    draw = lambda h: -F.ln(_uniform(F.col(h), 0) * _uniform(F.col(h), 38))
    twelve = lambda h: F.shiftright(F.col(h), 26).bitwiseAND(F.lit(0xFFF))
    rows = rows.select(*KEY, "g", *[f"l{s}" for s in sides], *[c for j in some for c in (draw(f"h{j}0").alias(f"r{j}"), F.ln(draw(f"h{j}1")).alias(f"c{j}"), ((twelve(f"h{j}0") * 4096 + twelve(f"h{j}1")) * F.lit(2.0**-24)).alias(f"b{j}"))])
    rank = lambda s, j: F.col(f"c{j}") - F.col(f"r{j}") * (F.rint(F.col(f"l{s}") / F.col(f"r{j}") + F.col(f"b{j}") - 0.5) - F.col(f"b{j}") + 1)
    least = rows.groupBy(*KEY, "g").agg(*[F.min(rank(s, j)).alias(f"v{s}_{j}") for s in sides for j in some])
    held = least.select(*KEY, F.struct("g", *[F.array(*[F.col(f"v{s}_{j}").cast("float") for j in some]).alias(f"v{s}") for s in sides]).alias("x"))
    whole = held.groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select(*KEY, *[F.flatten(F.col("x")[f"v{s}"]).alias(w) for s, w in enumerate(weights)])


def printed(samples: Column) -> Column:
    """Samples as text: eight hex digits each."""
    return F.when(samples.isNull() | samples[0].isNull(), F.lit("")).otherwise(F.array_join(F.transform(samples, lambda v: F.substring(F.format_string("%016x", F.xxhash64(v)), 9, 8)), ""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8))).cast("int"))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(samples)))


def words_of(texts: DataFrame) -> DataFrame:
    """(k1, k2, term, own, edited): how often a text and its edited form have each word; ``texts``: k1, k2, text, n, head."""
    stay = F.col("n") - (F.col("n") / 3).cast("long")
    part = texts.select(*KEY, F.split(F.expr("left(text, cast(n - n div 3 as int))"), BLANK).alias("a"), F.substring("text", (stay + 1).cast("int"), (F.col("n") - stay).cast("int")).alias("rest"), "head")
    cut = F.element_at("a", -1)  # the word that the cut goes through
    ways = F.array(
        F.struct(F.slice("a", 1, F.size("a") - 1).alias("w"), F.lit(1).alias("own"), F.lit(1).alias("edited")),
        F.struct(F.split(F.concat(cut, "rest"), BLANK).alias("w"), F.lit(1).alias("own"), F.lit(0).alias("edited")),
        F.struct(F.split(F.concat(cut, "head"), BLANK).alias("w"), F.lit(0).alias("own"), F.lit(1).alias("edited")),
    )
    rows = part.select(*KEY, F.explode(ways).alias("x")).select(*KEY, "x.own", "x.edited", F.explode("x.w").alias("word")).where("word <> ''")
    return rows.groupBy(*KEY, F.xxhash64("word").alias("term")).agg(F.sum("own").alias("own"), F.sum("edited").alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per document (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "doc_id", "text")
    links = neighbours(rows.groupBy(*KEY).agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text").cast("long")).alias("n"), F.count("*").alias("copies")))
    links = scratch.materialize(links, "neighbours")
    own = rows.select(*KEY, "text").groupBy(*KEY).agg(F.first("text").alias("text")).join(links.select(*KEY, "n", "last_k1", "last_k2", "last_need"), [*KEY])
    heads = own.select(F.col("last_k1").alias("k1"), F.col("last_k2").alias("k2"), F.expr("left(text, cast(last_need as int))").alias("head"))
    texts = own.select(*KEY, "text", "n").join(heads, [*KEY])
    prints = drawn(words_of(texts), ("own", "edited"), samples)
    edited = texts.select(*KEY, F.sha2(F.expr("concat(left(text, cast(n - n div 3 as int)), head)"), 256).alias("edited_sha256"))
    made = edited.join(prints, [*KEY], "left").select(*KEY, "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"))
    made = scratch.materialize(made, "prints")
    after = made.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("fingerprint").alias("next_fingerprint"))
    done = links.join(made, [*KEY]).join(after, ["next_k1", "next_k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    near = lambda b: likeness(F.col("fingerprint"), F.col(b), samples)
    return done.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

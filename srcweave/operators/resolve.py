"""Resolution joins: names in calls, types, renders and imports to what they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import first_by

#: Endings tried for a relative import without one, in order, and what else an ending may stand for.
IMPORT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
ENDING_SWAPS = {".js": (".ts", ".tsx"), ".jsx": (".tsx", ".ts"), ".mjs": (".mts", ".ts"), ".cjs": (".cts", ".ts")}


def resolve_names(refs: DataFrame, known: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (.., file_path, name) with (to_file, to_name, kind): defined in the same file first, else imported
    (imports: file_path, local, source_name, resolved_path); null where neither."""
    local = known.select("file_path", "name").distinct().withColumn("_here", F.lit(True))
    via = first_by(imports.where("resolved_path is not null"), ["file_path", "local"], F.col("resolved_path"))
    via = via.select("file_path", F.col("local").alias("name"), F.col("source_name").alias("_as"), F.col("resolved_path").alias("_from"))
    out = refs.join(local, ["file_path", "name"], "left").join(via, ["file_path", "name"], "left")
    here = F.col("_here").isNotNull()
    return out.withColumns({
        "to_file": F.when(here, F.col("file_path")).otherwise(F.col("_from")),
        "to_name": F.when(here, F.col("name")).when(F.col("_from").isNotNull(), F.coalesce("_as", "name")),
        "kind": F.when(here, F.lit("local")).when(F.col("_from").isNotNull(), F.lit("imported")).otherwise(F.lit("unresolved")),
    }).drop("_here", "_as", "_from")


def lookup(symbols: DataFrame, name: str | None = None, file: str | None = None, exported: bool | None = None) -> DataFrame:
    """Symbols by name, by file, by whether they are exported, or by several of these."""
    for column, want in (("name", name), ("file_path", file), ("is_exported", exported)):
        if want is not None:
            symbols = symbols.where(F.col(column) == want)
    return symbols


def count_resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(references, resolved, unresolved, symbols) of references by name."""
    names = symbols.select("name").distinct().withColumn("_ok", F.lit(True))
    seen = refs.select("name").join(names, "name", "left").agg(F.count("*").alias("references"), F.count("_ok").alias("resolved"))
    total = symbols.agg(F.count("*").alias("symbols")).scalar()
    return seen.select("references", "resolved", (F.col("references") - F.col("resolved")).alias("unresolved"), total.alias("symbols"))


def normalized(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def import_candidates(imports: DataFrame) -> DataFrame:
    """Relative or absolute imports (file_path, source) with every path to try (candidate) and its rank (pos).

    With an ending: the path itself, then its swaps. Without: each ending, then an index file with each.
    """
    source = F.col("source")
    base = normalized(F.when(source.startswith("/"), source).otherwise(F.concat(dirname(F.col("file_path")), F.lit("/"), source)))
    ending = F.regexp_extract("source", r"[^/.][^/]*?(\.[^./]*)$", 1)
    bare = F.expr("substring(_b, 1, length(_b) - length(_e))")
    swaps = F.array().cast("array<string>")
    for old, new in ENDING_SWAPS.items():
        swaps = F.when(F.col("_e") == old, F.array(*[F.concat(bare, F.lit(x)) for x in new])).otherwise(swaps)
    plain = F.array(*[F.concat("_b", F.lit(x)) for x in IMPORT_ENDINGS], *[F.concat("_b", F.lit(f"/index{x}")) for x in IMPORT_ENDINGS])
    tries = F.when(F.col("_e") != "", F.concat(F.array("_b"), swaps)).otherwise(plain)
    rel = imports.where(source.startswith(".") | source.startswith("/")).withColumn("_b", base).withColumn("_e", ending)
    return rel.select(*imports.columns, F.posexplode(tries).alias("pos", "candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with resolved_path: the first candidate that is a file; null for packages and misses."""
    hits = import_candidates(imports).join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = hits.groupBy("file_path", "source").agg(F.min_by("candidate", "pos").alias("resolved_path"))
    return imports.join(best, ["file_path", "source"], "left")


def python_candidates(imports: DataFrame, root: str) -> DataFrame:
    """Python modules (file_path, module) with candidate paths: leading dots climb from the file, others start at root."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    up = F.concat(dirname(F.col("file_path")), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)).cast("int")))
    base = normalized(F.concat(F.when(dots > 0, up).otherwise(F.lit(root)), F.lit("/"), rest))
    tries = F.array(F.concat("_b", F.lit(".py")), F.concat("_b", F.lit("/__init__.py")), F.concat("_b", F.lit(".pyi")))
    return imports.withColumn("_b", base).select(*imports.columns, F.posexplode(tries).alias("pos", "candidate"))


def resolve_python_imports(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    hits = python_candidates(imports, root).join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = hits.groupBy("file_path", "module").agg(F.min_by("candidate", "pos").alias("resolved_path"))
    return imports.join(best, ["file_path", "module"], "left")


def resolve_links(links: DataFrame) -> DataFrame:
    """Links (file_path, target) with is_internal, resolved (absolute path, or the file itself for an anchor), anchor."""
    t = F.col("target")
    external = t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | t.startswith("//")
    bare = F.regexp_replace(t, "#.*$", "")
    path = F.when(bare == "", F.col("file_path")).when(bare.startswith("/"), normalized(bare)).otherwise(normalized(F.concat(dirname(F.col("file_path")), F.lit("/"), bare)))
    anchor = F.regexp_extract(t, "#(.*)$", 1)
    return links.select(*links.columns, (~external).alias("is_internal"), F.when(~external, path).alias("resolved"), F.when(anchor != "", anchor).alias("anchor"))


PROBE = 4  # characters of a variable by which sinks are looked up


def taint_matches(sources: DataFrame, sinks: DataFrame, sanitizers: tuple[str, ...] = ()) -> DataFrame:
    """Sources (file, variable, ...) and sinks (file, argument, ...) of a file where the sink's argument has the source's
    variable in it and no sanitiser's name.

    An equi-join on the file and the variable's first ``PROBE`` characters: a sink lists its argument's stretches of up to
    that length once each, so pairs that share none never meet, and a file with very many of both is split by them. Neither side is collected to be broadcast. A
    variable as short as a stretch needs no further test. An empty variable is in every argument, a null one in none.
    """
    clean = F.lit(False)
    for s in sanitizers:
        clean = clean | F.col("argument").contains(s)
    size = F.length("argument")
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("argument", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    stretches = F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in range(1, PROBE + 1)]))
    probes = sinks.where(~clean).withColumn("_probe", F.explode(stretches))
    keyed = sources.withColumn("_probe", F.left("variable", F.lit(PROBE)))
    return keyed.hint("merge").join(probes, ["file", "_probe"]).where((F.length("variable") <= PROBE) | F.col("argument").contains(F.col("variable"))).drop("_probe")

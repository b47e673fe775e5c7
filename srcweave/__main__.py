"""Commands: ``python -m srcweave COMMAND ROOT ...``. An index is kept with ``--index`` and read again from there."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="srcweave")
    p.add_argument("--format", choices=("json", "csv", "table"), default="table")
    p.add_argument("--index", help="folder of a stored index; made there where it doesn't exist")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in (("extract", ("--include", "--exclude")), ("status", ()), ("map", ()), ("analyze", ("what", "symbol", "--depth")), ("query", ("text",)), ("search", ("term", "--limit"))):
        c = sub.add_parser(name)
        c.add_argument("root")
        for x in extra:
            many = {"nargs": "*", "default": []} if x in ("--include", "--exclude") else {"type": int, "default": 3 if x == "--depth" else 20} if x.startswith("--") else {}
            c.add_argument(x, **many)
    return p


def _service(spark: SparkSession, root: str, folder: str | None):
    from .operators.ingest import Snapshot
    from .service import Service
    from .sources.files import scan

    if folder and _exists(spark, f"{folder}/edges"):
        out = Service(spark, Snapshot.load(spark, folder, root.rstrip("/")))
        out.contents = scan(spark, root)
        return out
    out = Service.parse_project(spark, root, root.rstrip("/").rsplit("/", 1)[-1])
    if folder:
        out.snapshot.save(folder)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from .sources.files import extract_rows, scan

    if args.command == "extract":
        return extract_rows(scan(spark, args.root), args.root, args.include, args.exclude).orderBy("path", "kind", "name")
    s = _service(spark, args.root, args.index)
    if args.command == "status":
        return s.index_status()
    if args.command == "map":
        return s.repo_map().orderBy("dir").limit(100)
    if args.command == "analyze":
        return s.analyze(args.what, args.symbol, args.depth)
    return s.query(args.text) if args.command == "query" else s.search(args.term, limit=args.limit)


def show(rows: DataFrame, kind: str) -> str:
    from .sources.files import as_table

    if kind == "table":
        return as_table(rows)
    got = rows.toJSON().collect() if kind == "json" else None
    if got is not None:
        return "\n".join(got)
    quote = lambda v: '"' + ("" if v is None else str(v).replace('"', '""')) + '"'
    return "\n".join([",".join(rows.columns), *[",".join(map(quote, r)) for r in rows.collect()]])


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("srcweave").getOrCreate()
    print(show(run(spark, args), args.format))


if __name__ == "__main__":
    main(sys.argv[1:])

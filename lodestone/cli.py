"""The command line: index, search, live, status, and catalog list, pending, approve, reject and seed."""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure, UsageError
from lodestone.functions.vectors import get_embedder
from lodestone.operators.catalog import Catalog, listing, lookup_authors, review, seed, term_groups
from lodestone.operators.documents import search
from lodestone.output import lines
from lodestone.plans.index import Index, index_name, skipped
from lodestone.session import get_spark
from lodestone.sources.files import directory_arrivals, extract_text, make_source
from lodestone.streaming.ingest import ingest


def stop_time(at: str, now: datetime | None = None) -> datetime:
    """HH:MM today, or tomorrow if it has passed."""
    now = now or datetime.now()
    try:
        hour, minute = map(int, at.split(":"))
        then = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    except ValueError:
        raise UsageError(f"a time is HH:MM, not {at!r}") from None
    return then if then > now else then + timedelta(days=1)


def _index(spark, args, create: bool = False) -> Index:
    base = args.db or os.environ.get("LODESTONE_DATA_DIR", os.path.expanduser("~/.lodestone"))
    name = spark.range(1).select(index_name(os.path.abspath(args.directory))).first()[0]
    return Index(spark, f"{base}/{name}", create)


def _search(spark, index: Index, text: str, args):
    asked = spark.createDataFrame([(0, text)], "qid long, query string")
    embed = get_embedder(index.manifest["meta"]["embedder"], index.manifest["meta"]["model"])
    tags, authors, types = facet_groups(spark, index.catalog(), args.tag or [], args.author or [], args.type)
    return lines(search(index.tables(), asked, embed, args.n, args.agg, not args.no_hybrid, not args.no_dedup, tags, authors, types), args.json)


def _report(index: Index) -> str:
    """What the last run did, and the files that have no text or failed."""
    lines = ["processed: " + (", ".join(f"{n} {k}" for k, n in sorted(index.report.items())) or "nothing")]
    return "\n".join([*lines, *(f"skipped: {r['path']} ({r['status']})" for r in skipped(index.table("files")).collect())])


def facet_groups(spark, catalog: Catalog, tags: list[str], authors: list[str], doc_type: str | None) -> tuple[list[list[str]], list[list[str]], list[str] | None]:
    """Facet values with the equivalent names that the catalog has; an unknown one stands for itself."""
    asked = [("tag", t) for t in tags] + ([("doctype", doc_type)] if doc_type else [])
    found = {}
    if asked:
        found = {(r["kind"], r["term"]): r["group"] for r in term_groups(spark.createDataFrame(asked, "kind string, term string"), catalog).collect()}
    people = lookup_authors(authors, catalog)
    return [found["tag", t] for t in tags], [people[a] for a in authors], found["doctype", doc_type] if doc_type else None


def _catalog(spark, index: Index, args) -> list[str]:
    """Lists or changes the stored catalog."""
    c = index.catalog()
    if args.action == "list":
        return [f"{r['usage']}\t{r['name']}\t{r['aliases']}" for r in listing(c, args.value or "tag").collect()]
    if args.action == "seed":
        index.set_catalog(seed(c, spark.read.text(args.value), "tag", get_embedder(index.manifest["meta"]["embedder"], index.manifest["meta"]["model"])))
        return []
    if args.action != "pending":
        if not (args.value or "").isdigit():
            raise UsageError(f"catalog {args.action} needs the number of a merge")
        index.set_catalog(review(c, int(args.value), args.action == "approve"))
    rows = index.catalog().merges.where("status = 'pending'").orderBy("id").collect()
    return [f"{r['id']}\t{r['kind']}\t{r['keep_name']}\t{r['drop_name']}\t{r['rationale']}" for r in rows]


def run(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "live", "status", "catalog"):
        p = commands.add_parser(name)
        p.add_argument("directory")
        p.add_argument("--db")
        if name == "index":
            p.add_argument("--model")
            p.add_argument("--chunker")
            p.add_argument("--embedder")
            p.add_argument("--source", default="auto")
            p.add_argument("--limit", type=int)
            p.add_argument("--stop-at")
            p.add_argument("--arrivals", action="store_true", help="take only the files that arrived since the last such run")
        if name == "catalog":
            p.add_argument("action", choices=["list", "pending", "approve", "reject", "seed"])
            p.add_argument("value", nargs="?", help="a kind, a merge's number, or a vocabulary file")
        if name == "search":
            p.add_argument("query")
        if name in ("search", "live"):
            p.add_argument("-n", type=int, default=10)
            p.add_argument("--agg", default="max")
            p.add_argument("--tag", action="append")
            p.add_argument("--author", action="append")
            p.add_argument("--type")
            p.add_argument("--no-hybrid", action="store_true")
            p.add_argument("--no-dedup", action="store_true")
            p.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = get_spark()
    if args.command == "index":
        index = _index(spark, args, create=True)
        text = extract_text(F.col("content"), F.col("path"), F.col("content_type"), errors=True)
        settings = {"chunker": args.chunker, "embedder": args.embedder, "model": args.model}
        if args.arrivals:
            arrived = directory_arrivals(spark, os.path.abspath(args.directory), args.limit or 1000)
            ingest(index, arrived, text, "arrivals", f"{index.path}/arrivals", **settings).awaitTermination()
            print(_report(index), file=sys.stderr)
            return 0
        source = make_source(spark, os.path.abspath(args.directory), args.source)
        until = stop_time(args.stop_at) if args.stop_at else None
        counts = index.sync(source, text, limit=args.limit or (100 if until else None), **settings)
        while until and datetime.now() < until and counts["new"] + counts["changed"] + counts["retry"]:
            counts = index.sync(source, text, limit=100, **settings)
        print(", ".join(f"{n} {k}" for k, n in counts.items()), file=sys.stderr)
        print(_report(index), file=sys.stderr)
    elif args.command == "catalog":
        print("\n".join(_catalog(spark, _index(spark, args), args)))
    elif args.command == "search":
        for row in _search(spark, _index(spark, args), args.query, args).collect():
            print(row["line"])
    elif args.command == "live":
        index = _index(spark, args)
        for line in sys.stdin:
            started = time.time()
            if line.strip():
                for row in _search(spark, index, line.strip(), args).collect():
                    print(row["line"])
            print(flush=True)
            print(f"{time.time() - started:.1f} s", file=sys.stderr)
    else:
        print(_index(spark, args).status())
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except (UsageError, EnvironmentFailure) as e:
        print(e, file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())

"""Command line over the library."""

from __future__ import annotations

import argparse
import platform
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from litspark import pipelines
from litspark.config import Config
from litspark.functions.context import input_budget
from litspark.providers import ProviderError, provider
from litspark.ship import ship
from litspark.sources.feed import FeedClient, http_get, in_dates, ranked, read_files
from litspark.sources.fetch import HttpPage, PageFetcher
from litspark.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="litspark", description="Literature analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    c = sub.add_parser("search", help="search the feed, or read feed files, into a collection")
    c.add_argument("--query", required=True)
    c.add_argument("--from", dest="date_from", required=True)
    c.add_argument("--to", dest="date_to", required=True)
    c.add_argument("--name", required=True)
    c.add_argument("--max", dest="most", type=int, default=100)
    c.add_argument("--print-limit", type=int, default=20)
    c.add_argument("--files", help="feed files to read in place of the network")
    sub.add_parser("collections")
    c = sub.add_parser("papers")
    c.add_argument("--collection")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("summarize")
    c.add_argument("--collection")
    c.add_argument("--limit", type=int)
    c.add_argument("--pages", help="Parquet of arxiv_id and html: read their sections, too")
    c.add_argument("--deep", action="store_true", help="fetch the papers' HTML and read their sections, too")
    c.add_argument("--force", action="store_true")
    _model(c)
    c = sub.add_parser("synthesize")
    c.add_argument("--collection")
    c.add_argument("--goal", default="")
    _model(c)
    c = sub.add_parser("route")
    c.add_argument("--collection")
    c = sub.add_parser("cells")
    cells = c.add_subparsers(dest="cell_command")
    x = cells.add_parser("create")
    x.add_argument("name")
    x.add_argument("--description", default="")
    x.add_argument("--parent")
    x = cells.add_parser("split")
    x.add_argument("parent")
    x.add_argument("children", nargs="+")
    cells.add_parser("list")
    c = sub.add_parser("rag")
    c.add_argument("--question", required=True)
    c.add_argument("--collection")
    c.add_argument("--cell")
    c.add_argument("--limit", type=int, default=8)
    _model(c)
    sub.add_parser("doctor")
    return p


def _model(p: argparse.ArgumentParser) -> None:
    p.add_argument("--provider", choices=["auto", "ollama", "extractive"])
    p.add_argument("--model")


def lines(a: argparse.Namespace, spark: SparkSession, config: Config) -> Iterator[str]:
    """What a command says, line by line, as it goes on."""
    store = Store(spark, config.store).init()
    if getattr(a, "provider", None):
        config.provider = a.provider
    if getattr(a, "model", None):
        config.model = a.model
    budget = input_budget(config.context_tokens, config.output_reserve)
    model = lambda: provider(config.provider, config.model, config.server)
    day = lambda r: (r["published"] or "")[:10]

    if a.command == "init":
        yield f"Store: {config.store}"
    elif a.command == "search":
        if a.files:
            within = read_files(spark, a.files).where(in_dates(F.col("published"), a.date_from, a.date_to))
            first = within.orderBy(F.desc("published"), "arxiv_id").limit(a.most)
            papers = ranked(first, F.desc("published"), F.col("arxiv_id"))
            count = pipelines.ingest(store, papers, a.name, a.query, a.date_from, a.date_to)
        else:
            client = FeedClient(http_get(config.user_agent), config.feed_delay)
            count = pipelines.search(store, client, a.query, a.date_from, a.date_to, a.name, a.most)
        yield f"Collection: {a.name}"
        yield f"Found: {count}"
        for r in store.collection_papers(a.name, a.print_limit).collect():
            yield f"- {r['arxiv_id']} {day(r)} {r['title']}"
    elif a.command == "collections":
        rows = store.list_collections().collect()
        if not rows:
            yield "No collections"
        for r in rows:
            yield f"{'*' if r['active'] else ' '} {r['name']:<28} papers={r['paper_count']} created={r['created_at']}"
    elif a.command == "papers":
        shown = 0
        for shown, r in enumerate(store.collection_papers(a.collection, a.limit).select("arxiv_id", "published", "title").toLocalIterator(), 1):
            yield "\t".join((r["arxiv_id"], day(r), r["title"] or ""))
        yield f"Total shown: {shown}"
    elif a.command == "summarize":
        pages = spark.read.parquet(a.pages) if a.pages else None
        fetcher = PageFetcher(HttpPage(config.user_agent), config.page_delay) if a.deep and pages is None else None
        for r in pipelines.summarize(store, model(), config.model, budget, a.collection, a.limit, a.force, pages, fetcher).toLocalIterator():
            yield f"\n=== {r['arxiv_id']} [{r['source']}] ===\n{r['summary']}"
    elif a.command == "synthesize":
        yield pipelines.synthesize(store, model(), budget, a.collection, a.goal)
    elif a.command == "route":
        routes = pipelines.route_collection(store, a.collection)
        line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.format_string("%s:%.2f", "cell", "score").alias("x")))), lambda r: r.x), ", ")
        for r in routes.groupBy("arxiv_id").agg(line.alias("line")).orderBy("arxiv_id").toLocalIterator():
            yield f"{r['arxiv_id']} -> {r['line']}"
    elif a.command == "cells" and a.cell_command == "create":
        yield f"Created cell: {store.create_cell(a.name, a.description, a.parent)['name']}"
    elif a.command == "cells" and a.cell_command == "split":
        store.split_cell(a.parent, a.children)
        yield f"Split {a.parent} -> {', '.join(a.children)}"
    elif a.command == "cells":
        for r in store.list_cells().collect():
            yield f"{r['name']:<20} parent={r['parent_name'] or '-':<20} papers={r['paper_count']}"
    elif a.command == "rag":
        active = store.get_collection()
        said = pipelines.answer(store, model(), a.question, a.collection or (active["name"] if active else None), a.cell, a.limit)
        yield "Nothing in scope holds a term of the question." if said is None else said
    elif a.command == "doctor":
        yield f"Python: {platform.python_version()}"
        yield f"Spark: {spark.version}"
        yield f"Store: {config.store}"
        try:
            yield f"Provider: {model().name} model: {config.model}"
        except ProviderError as e:
            yield f"Provider: unavailable, {e}"


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("litspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    for line in lines(a, spark, Config()):
        print(line)


if __name__ == "__main__":
    main()

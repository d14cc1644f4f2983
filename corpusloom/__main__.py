"""python -m corpusloom ingest|refresh|fetch|search ...: the collections from the command line; an unknown option ends with 2."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from corpusloom.operators import corpus, feeds, search
from corpusloom.sources import http, library, markdown, tables
from corpusloom.sources.generations import Generations


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("corpusloom")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="build the corpus of all feeds, or bring it up to date, as a new generation")
    ingest.add_argument("--feeds", required=True, help="a JSON file with the list of feeds")
    ingest.add_argument("--store", required=True)
    ingest.add_argument("--author", default="")
    ingest.add_argument("--export", help="a folder for the Markdown files of both collections")
    ingest.add_argument("--dry-run", action="store_true", help="count the records and write nothing")
    refresh = commands.add_parser("refresh", help="rewrite terms and sources from folders of Markdown")
    refresh.add_argument("--terms", required=True)
    refresh.add_argument("--posts", required=True)
    refresh.add_argument("--collection", required=True)
    refresh.add_argument("--author", required=True)
    refresh.add_argument("--out", required=True)
    fetch = commands.add_parser("fetch", help="posts by their slugs, to a table")
    fetch.add_argument("--base", required=True)
    fetch.add_argument("--slugs", required=True, type=feeds.split_list)
    fetch.add_argument("--transport", choices=["http", "folder"], default="http")
    fetch.add_argument("--out", required=True)
    fetch.add_argument("--dry-run", action="store_true")
    find = commands.add_parser("search", help="ranked search over search documents")
    find.add_argument("--docs", required=True)
    find.add_argument("query")
    return top


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    if given.command == "ingest":
        with open(given.feeds, encoding="utf-8") as f:
            terms, sources = library.load(spark, json.load(f))
        if given.dry_run:
            print(f"{terms.count()} terms, {sources.count()} sources")
            return 0
        made = corpus.build(Generations(spark, given.store), terms, sources)
        print(f"generation {made.number}: " + ", ".join(f"{v} {k}" for k, v in made.counts.items()))
        if given.export:
            markdown.refresh(*corpus.records(made), given.export, given.author).show()
    elif given.command == "refresh":
        terms = markdown.parse_terms(markdown.read_folder(spark, given.terms))
        posts = markdown.parse_posts(markdown.read_folder(spark, given.posts), given.collection, "post", author=given.author)
        markdown.refresh(terms, posts, given.out, given.author).show()
    elif given.command == "fetch":
        spark.dataSource.register(http.PostsSource)
        have = tables.saved_slugs(spark, given.out)
        wanted = [s for s in given.slugs if s not in have]
        if given.dry_run:
            print("\n".join(wanted))
            return 0
        if wanted:
            options = {"base": given.base, "slugs": ",".join(wanted), "transport": given.transport}
            spark.read.format("posts").options(**options).load().write.mode("append").parquet(given.out)
        http.raise_failures(spark.read.parquet(given.out), wanted)
    else:
        search.search(tables.read_search_docs(spark, given.docs), given.query).show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

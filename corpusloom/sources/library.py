"""A library's feeds by configuration: what to read, as what, and in which order.

A feed is a dictionary: ``parser`` and its options, and ``yields`` where it gives way to all feeds before it (else it
replaces what they had under the same slug). Parsers of this module are lexicon, terms, book, posts and draft;
others are registered with ``feeds.register_parser`` and give rows of either collection's schema. A path that is
missing gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, feeds, split
from corpusloom.schema import SOURCES, TERMS, enforce_schema
from corpusloom.sources import markdown


def document(spark: SparkSession, path: str) -> DataFrame:
    """name, text of one file, or no rows where it is missing."""
    return markdown.read_document(spark, path) if markdown.exists(spark, path) else spark.createDataFrame([], "name string, text string")


def named(prefix: str, title: Column) -> Column:
    """A slug of the collection and the title; without a collection, of the title alone."""
    return F.concat_ws("-", *([F.lit(prefix)] if prefix else []), T.slugify(title))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    return enforce_schema(split.lexicon(document(spark, path), "name", "text").withColumn("source", F.col("origin")), TERMS)


def terms(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    return markdown.parse_terms(markdown.read_folder(spark, path, optional=True), compat).withColumn("file", F.concat("slug", F.lit(".md")))


def book(spark: SparkSession, path: str, collection: str, date: str | None = None, author: str | None = None, tags: Sequence[str] = (), kind: str = "book-section", prefix: str | None = None, compat: bool = False) -> DataFrame:
    prefix = collection.lower() if prefix is None else prefix
    rows = split.book(document(spark, path), "name", "text", compat=compat)
    body = F.col("body")
    return enforce_schema(rows.select(
        named(prefix, F.col("title")).alias("slug"), "title", "subtitle", F.lit(collection).alias("collection"), F.lit(kind).alias("kind"), "order", F.lit(date).alias("date"), F.lit(author).alias("author"),
        T.first_sentences(body).alias("excerpt"), T.word_count(body).alias("word_count"), F.array(F.lit(collection), *map(F.lit, tags)).alias("tags"), body.alias("body_md"), F.col("order").alias("ord"),
    ), SOURCES)


def posts(spark: SparkSession, path: str, collection: str, kind: str = "post", date: str | None = None, author: str | None = None, own_slug: bool = False, skip_underscore: bool = True, compat: bool = False) -> DataFrame:
    """Files of a folder, or a single file. With own_slug a file's name is its slug, else the collection's name comes before it."""
    if path.endswith(".md"):
        files = document(spark, path).select(F.regexp_replace("name", r"\.md\z", "").alias("slug"), "text")
    else:
        files = markdown.read_folder(spark, path, skip_underscore=skip_underscore, optional=True).select("slug", "text")
    files = files.withColumn("ord", F.concat("slug", F.lit(".md")))
    rows = markdown.parse_posts(files, collection, kind, date, author, compat, own_slug)
    return rows.withColumn("related", F.array().cast("array<string>")).withColumnRenamed("ord", "file")


def draft(spark: SparkSession, path: str, collection: str, title: str = "Draft", kind: str = "draft", date: str | None = None, author: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """One file without a header, named by its first heading."""
    body = T.trim(F.regexp_replace("text", r"\A#\s+.+\n+", ""))
    rows = document(spark, path).select("name", T.trim(split.draft_title(F.col("text"), title)).alias("title"), body.alias("body_md"))
    return enforce_schema(rows.select(
        named(slug_part(collection), F.col("title")).alias("slug"), "title", F.lit("").alias("subtitle"), F.lit(collection).alias("collection"), F.lit(kind).alias("kind"), F.lit(date).alias("date"), F.lit(author).alias("author"),
        T.first_sentences(F.col("body_md")).alias("excerpt"), T.word_count(F.col("body_md")).alias("word_count"), F.array(F.lit(collection), *map(F.lit, tags)).alias("tags"), "body_md", F.lit(0).alias("ord"),
    ), SOURCES)


def slug_part(collection: str) -> str:
    """The collection's part of a slug, of a constant."""
    return "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in collection.lower()).split())


for _name, _parser in {"lexicon": lexicon, "terms": terms, "book": book, "posts": posts, "draft": draft}.items():
    feeds.register_parser(_name, _parser)


def load(spark: SparkSession, given: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """Terms and sources of all feeds, as ``corpus.build`` takes them."""
    found: dict[str, list[tuple[DataFrame, bool]]] = {"terms": [], "sources": []}
    for place, feed in enumerate(given):
        rows = feeds.load_feed(spark, feed["parser"], **{k: v for k, v in feed.items() if k not in ("parser", "yields")})
        by = F.col("file" if "file" in rows.columns else "ord")
        kind = "terms" if "related_names" in rows.columns else "sources"
        text = F.col("body_text" if kind == "terms" else "body_md")
        rows = corpus.placed(rows, place, by).drop("file").withColumn("text", F.coalesce(text, F.lit("")))
        found[kind].append((rows, bool(feed.get("yields"))))
    empty = {"terms": TERMS, "sources": SOURCES}
    out = []
    for kind, parts in found.items():
        if not parts:
            rows = enforce_schema(spark.createDataFrame([], empty[kind]), empty[kind]).withColumn("text", F.lit("")).withColumn("ord", F.col("ord").cast("string"))
            parts = [(rows, False)]
        out.append(corpus.combine([r for r, _ in parts], [y for _, y in parts]))
    return out[0], out[1]

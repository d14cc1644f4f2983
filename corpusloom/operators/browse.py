"""What a reader asks of the collections: browse, filter, one document, an overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def by_letter(terms: DataFrame, icu: bool = False) -> DataFrame:
    """Letter, number of terms, and their slugs by title; icu orders titles as a reader would, else by their bytes."""
    title = F.collate("title", "UNICODE") if icu else F.col("title")
    rows = terms.withColumn("letter", F.upper(F.coalesce(F.nullif("letter", F.lit("")), F.substring("title", 1, 1))))
    w = Window.partitionBy("letter").orderBy(title, "slug")
    return rows.withColumn("rank", F.row_number().over(w)).groupBy("letter").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda x: x["slug"]), ",").alias("slugs"))


def facet_counts(docs: DataFrame, names: list[str] | DataFrame, column: str = "collection") -> DataFrame:
    """(pos, name, n) of each category of a list, or of a table (pos, name), zeros too."""
    dim = names if isinstance(names, DataFrame) else docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    counts = docs.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return dim.join(counts, "name", "left").select("pos", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def by_collection(docs: DataFrame, names: list[str], icu: bool = False) -> DataFrame:
    """Documents of the listed collections with their rank within, by order, then title; empty groups don't appear."""
    title = F.collate("title", "UNICODE") if icu else F.col("title")
    dim = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, collection string")
    w = Window.partitionBy("collection").orderBy("order", title, "slug")
    return docs.join(dim, "collection").withColumn("rank", F.row_number().over(w)).select("pos", "collection", "rank", "slug", "title")


def filter_terms(terms: DataFrame, query: str) -> DataFrame:
    """Terms whose title, subtitle, body or tags hold the query, in any case."""
    every = F.lower(F.concat_ws(" ", "title", "subtitle", "text", F.array_join("tags", " ")))
    return terms.where(F.contains(every, F.lit(query.strip().lower())))


def document(docs: DataFrame, mentions: DataFrame, related: DataFrame, terms: DataFrame, slug: str) -> DataFrame:
    """One document with the terms it discusses and related reading, by title; ids without a row are left out."""
    one = docs.where(F.col("slug") == slug).select("slug", "title", "collection")
    found = mentions.where(F.col("doc") == slug).join(terms.select(F.col("slug").alias("term"), F.col("title").alias("name")), "term")
    near = related.where(F.col("src") == slug).join(docs.select(F.col("slug").alias("dst"), F.col("title").alias("name")), "dst")
    discussed = found.agg(F.array_sort(F.collect_list(F.struct("name", "term"))).alias("terms"))
    reading = near.agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "name"))).alias("related"))
    return one.join(discussed).join(reading)


def overview(terms: DataFrame, docs: DataFrame, featured: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The featured terms with their previews, and counts per category."""
    return terms.where(F.col("slug").isin(featured)).select("slug", "title", T.preview(F.col("text")).alias("preview")), facet_counts(docs, names)


def filter_counter(terms: DataFrame, query: str) -> DataFrame:
    """One row: how many terms a filter shows, of how many, the line that says so, and the letters that keep a term."""
    q = query.strip().lower()
    rows = terms.select("slug", "letter").join(filter_terms(terms, query).select("slug", F.lit(True).alias("hit")), "slug", "left")
    found = rows.agg(F.count_if("hit").alias("shown"), F.count("*").alias("total"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("letter")))), ",").alias("letters"))
    label = F.format_string("%d of %d", "shown", "total") if q else F.format_string("%d terms", "total")
    return found.select("shown", "total", label.alias("label"), "letters")


#: How many related terms and sources an entry shows.
RELATED, DISCUSSED = 8, 6


def dictionary_page(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """letter, slug, title, related, discussed of each term, titles joined by "; ".

    Of related terms the first RELATED are taken and those without a row dropped; of sources those without a row are
    dropped and the first DISCUSSED taken. The arrays are exploded without the terms' other columns.
    """

    def shown(column: str, rows: DataFrame, before: int | None, after: int | None) -> DataFrame:
        names = rows.select(F.col("slug").alias("ref"), F.col("title").alias("name"))
        refs = terms.select("slug", F.posexplode(column).alias("pos", "ref"))
        found = (refs if before is None else refs.where(F.col("pos") < before)).join(names, "ref")
        if after is not None:
            w = Window.partitionBy("slug").orderBy("pos")
            found = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= after)
        line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "; ")
        return found.groupBy("slug").agg(line.alias(column))

    related, discussed = shown("related", terms, RELATED, None), shown("provenance", sources, None, DISCUSSED)
    rows = terms.select("slug", "title", F.upper(F.coalesce(F.nullif("letter", F.lit("")), F.substring("title", 1, 1))).alias("letter"))
    rows = rows.join(related, "slug", "left").join(discussed, "slug", "left")
    return rows.select("letter", "slug", "title", F.coalesce("related", F.lit("")).alias("related"), F.coalesce("provenance", F.lit("")).alias("discussed"))


def link_counts(terms: DataFrame) -> DataFrame:
    """One row: links between terms and from terms to sources; null arrays have none."""
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("bigint")
    return terms.agg(size("related").alias("term_links"), size("provenance").alias("citations"))

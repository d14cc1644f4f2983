"""The whole corpus build: feeds to two collections, their links, and the maintenance of both when feeds change.

terms: slug, title, text, related_names, ord and any others. sources: slug, title, text, collection, ord and any
others. ord is a string that sorts as the input: place of the feed, then the place in it, by file name or by number,
so a new file leaves the ord of all others as it is.

A generation (see ``sources.generations``) has these tables:

    terms, sources        the records with their digest
    provenance            (term, doc): a document mentions a term
    mentions              (doc, term): a term's text mentions another term
    links                 (src, dst, way): see-also names, then mentions, uncapped, in the order of way
    first                 (src, dst, rank): links, capped
    related_terms         (src, dst, rank): these and the backlinks of others, capped again
    related_docs          (src, dst, shared, same, rank)

An update finds by their digests the records that are new, changed or gone. Only these meet the others' texts or titles.
Links are narrow; the terms whose links differ are ranked again, and then those they link to or did. Documents
are related again where their own terms changed, where they share a term with such a document, and where the
head of their collection changed and they take from it. The result equals a build from nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import xref
from corpusloom.sources.generations import Generation, Generations, plain_unions

MOST_TERMS, MOST_DOCS = 12, 5


def placed(rows: DataFrame, place: int, by: Column) -> DataFrame:
    """A feed's rows with their ord: by is a file's name or a number."""
    numeric = rows.select(by).schema[0].dataType.simpleString() != "string"
    return rows.withColumn("ord", F.concat(F.lit(f"{place:04d}/"), F.lpad(by.cast("string"), 20, "0") if numeric else by))


def combine(given: Sequence[DataFrame], yields: Sequence[bool]) -> DataFrame:
    """All feeds' records, one of a slug: within a feed the last; a feed that yields gives way to all before it, any other replaces what they had.

    Only slugs and ords are compared; the records meet the winners once.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("corpusloom_yields", F.lit(y)) for f, y in zip(given, yields, strict=True)])
    place = F.substring("ord", 1, 4).cast("int")
    order = F.when(F.col("corpusloom_yields"), F.struct(F.lit(0).alias("a"), (-place).alias("b"), F.col("ord"))).otherwise(F.struct(F.lit(1).alias("a"), place.alias("b"), F.col("ord")))
    winners = rows.groupBy("slug").agg(F.max_by("ord", order).alias("ord"))
    return rows.drop("corpusloom_yields").join(winners, ["slug", "ord"], "left_semi")


def with_digest(rows: DataFrame) -> DataFrame:
    """Equal digests: equal records, in all columns."""
    whole = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.withColumn("digest", F.sha2(whole.cast("binary"), 256))


def differing(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """slug of the records that are only in one of the two or differ."""
    if old is None:
        return new.select("slug")
    a, b = old.select("slug", F.col("digest").alias("was")), new.select("slug", "digest")
    return a.join(b, "slug", "full_outer").where("was is null or digest is null or was <> digest").select("slug")


def among(rows: DataFrame, slugs: DataFrame, column: str = "slug", how: str = "left_semi") -> DataFrame:
    return rows.join(slugs.toDF(column), column, how).select(*rows.columns)


def matched(terms: DataFrame, docs: DataFrame, changed_terms: DataFrame, changed_docs: DataFrame, match) -> DataFrame:
    """What match(terms, docs) gives for pairs of which one side has changed."""
    fresh = match(among(terms, changed_terms), docs)
    return fresh.unionByName(match(among(terms, changed_terms, how="left_anti"), among(docs, changed_docs)))


def term_mentions(terms: DataFrame, docs: DataFrame) -> DataFrame:
    return xref.mention_join(terms, docs.select("slug", "text"), 5, True).where("term <> doc").select("doc", "term")


def links_of(terms: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src, dst, way): a term's see-also names by their place, then its mentions by the ord of the term."""
    see = xref.see_also(terms).select("src", "dst", F.concat(F.lit("0/"), F.lpad(F.col("k").cast("string"), 10, "0")).alias("way"))
    ords = terms.select(F.col("slug").alias("dst"), "ord")
    found = mentions.select(F.col("doc").alias("src"), F.col("term").alias("dst")).join(ords, "dst").select("src", "dst", F.concat(F.lit("1/"), F.col("ord")).alias("way"))
    return see.unionByName(found).groupBy("src", "dst").agg(F.min("way").alias("way"))


def with_backlinks(first: DataFrame, terms: DataFrame, only: DataFrame) -> DataFrame:
    """(src, dst, rank) of the terms asked for: their own capped links, then those of other terms to them."""
    own = among(first, only, "src").select("src", "dst", F.concat(F.lit("0/"), F.lpad(F.col("rank").cast("string"), 10, "0")).alias("way"))
    ords = terms.select(F.col("slug").alias("dst"), "ord")
    back = among(first, only, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(ords, "dst").select("src", "dst", F.concat(F.lit("1/"), F.col("ord")).alias("way"))
    return xref.ranked(own.unionByName(back), ["way"], MOST_TERMS)


def heads(docs: DataFrame) -> DataFrame:
    """The documents of each collection that those without company may take."""
    w = Window.partitionBy("collection").orderBy("ord")
    return docs.select("slug", "collection", "ord").withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * MOST_DOCS)


def all_of(old: Generation | None, name: str, empty: DataFrame) -> DataFrame:
    return old.table(name) if old is not None else empty.where(F.lit(False))


def build(store: Generations, terms: DataFrame, sources: DataFrame) -> Generation:
    """Publishes the generation of these records: a build from nothing if there is none yet, else an update of the current one."""
    with plain_unions(store.spark):
        return _build(store, terms, sources)


def _build(store: Generations, terms: DataFrame, sources: DataFrame) -> Generation:
    old, draft = store.current(), store.draft()
    terms, sources = with_digest(terms), with_digest(sources)

    def write(name: str, rows: DataFrame, withdrawn: dict[str, DataFrame]) -> DataFrame:
        return store.write(draft, name, rows, withdrawn if old else None)

    t_gone, d_gone = (differing(old.table(n) if old else None, rows) for n, rows in (("terms", terms), ("sources", sources)))
    # what differs is written down once: everything else refers to it
    t_gone = store.write(draft, "changed_terms", t_gone)
    d_gone = store.write(draft, "changed_sources", d_gone)
    terms = write("terms", among(terms, t_gone), {"slug": t_gone})
    sources = write("sources", among(sources, d_gone), {"slug": d_gone})

    provenance = write("provenance", matched(terms, sources, t_gone, d_gone, xref.provenance), {"term": t_gone, "doc": d_gone})
    mentions = write("mentions", matched(terms, terms, t_gone, t_gone, term_mentions), {"term": t_gone, "doc": t_gone})

    links = links_of(terms, mentions)
    before = all_of(old, "links", links)
    moved = links.exceptAll(before).union(before.exceptAll(links)).select(F.col("src").alias("slug")).union(t_gone).distinct()
    moved = store.write(draft, "moved_terms", moved)
    links = write("links", among(links, moved, "src"), {"src": moved})
    first = write("first", xref.ranked(among(links, moved, "src"), ["way"], MOST_TERMS), {"src": moved})
    touched = reduce(DataFrame.union, [among(f, moved, "src").select(F.col("dst").alias("slug")) for f in (first, all_of(old, "first", first))], moved).distinct()
    touched = store.write(draft, "touched_terms", touched)
    write("related_terms", with_backlinks(first, terms, touched), {"src": touched})

    was, empty = all_of(old, "provenance", provenance), store.spark.createDataFrame([], "src string, dst string, shared bigint, same int, rank int")
    own = provenance.exceptAll(was).union(was.exceptAll(provenance)).select(F.col("doc").alias("slug")).union(d_gone).distinct()
    shared = among(provenance.union(was), own, "doc").select("term").distinct()
    company = among(provenance, shared, "term").select(F.col("doc").alias("slug"))
    new_heads = heads(sources)
    old_heads = heads(old.table("sources")) if old else new_heads.where(F.lit(False))
    other = new_heads.exceptAll(old_heads).union(old_heads.exceptAll(new_heads)).select("collection").distinct()
    served = all_of(old, "related_docs", empty).where("shared > 0").groupBy(F.col("src").alias("slug")).agg(F.count("*").alias("n"))
    # a collection without a name has no company by collection
    alone = sources.join(other, "collection", "left_semi").join(served, "slug", "left").where(F.coalesce("n", F.lit(0)) < MOST_DOCS).select("slug")
    # each is written by itself: a union of joins whose skewed parts are split at run time may not be planned
    store.write(draft, "touching", own)
    store.write(draft, "touching", company, {})
    again = store.write(draft, "touched_sources", store.write(draft, "touching", alone, {}).distinct())
    found = xref.related_docs(sources, provenance, MOST_DOCS, only=again)
    write("related_docs", found.select("src", "dst", "shared", "same", "rank"), {"src": again})
    names = ("terms", "sources", "provenance", "changed_terms", "changed_sources", "touched_terms", "touched_sources")
    counted = reduce(DataFrame.union, [draft.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names])
    draft.counts = {r["name"]: r["n"] for r in counted.collect()}
    return store.publish(draft)


def edges(generation: Generation) -> DataFrame:
    """kind, src, dst, rank of all links of a generation; provenance has no rank."""
    none = F.lit(None).cast("int").alias("rank")
    parts = [
        generation.table("provenance").select(F.lit("provenance").alias("kind"), F.col("term").alias("src"), F.col("doc").alias("dst"), none),
        generation.table("related_terms").select(F.lit("related_term").alias("kind"), "src", "dst", "rank"),
        generation.table("related_docs").select(F.lit("related_doc").alias("kind"), "src", "dst", "rank"),
    ]
    return reduce(DataFrame.unionByName, parts)


def records(generation: Generation) -> tuple[DataFrame, DataFrame]:
    """Terms with related and provenance, sources with related, as arrays in order: what files and pages show."""

    def listed(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        return rows.groupBy(F.col(key).alias("slug")).agg(F.transform(pairs, lambda p: p["v"]).alias(name))

    none = F.array().cast("array<string>")
    terms, sources = generation.table("terms").drop("related", "provenance", "digest"), generation.table("sources").drop("related", "digest")
    cited = generation.table("provenance").join(sources.select(F.col("slug").alias("doc"), "ord"), "doc")
    related, cited = listed(generation.table("related_terms"), "src", "dst", "rank", "related"), listed(cited, "term", "doc", "ord", "provenance")
    terms = terms.join(related, "slug", "left").join(cited, "slug", "left").withColumns({c: F.coalesce(c, none) for c in ("related", "provenance")})
    near = listed(generation.table("related_docs"), "src", "dst", "rank", "related")
    return terms, sources.join(near, "slug", "left").withColumn("related", F.coalesce("related", none))

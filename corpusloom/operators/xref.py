"""Cross references: see-also links, mentions of titles in texts, backlinks, provenance and related documents.

mention_join meets titles and texts by an equi-join on a title's first two words, or its only one: a
text is tokenised once, and only its keys are exploded, without the text. Texts meet the pairs that are
left, which are hardly more than the result, once, and the exact pattern is applied to these. No text is
compared with all titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.generations import plain_unions, scratch

ASCII_WORD = "[a-z0-9_]+"
LONG_S = "\u017f"


def mention_join(terms: DataFrame, docs: DataFrame, least: int = 4, normalised: bool = False) -> DataFrame:
    """(term, doc) of documents (slug, text) that hold a term's title (slug, title) as a whole phrase, in any case.

    Titles shorter than ``least`` characters, counted after normalising if so asked, find nothing.
    """
    size = F.length(T.norm_title(F.col("title"))) if normalised else F.length("title")
    needles = terms.where(size >= least).select(F.col("slug").alias("term"), T.norm_title(F.col("title")).alias("needle"), T.mention_regex(F.col("title")).alias("pattern"))
    needles = needles.withColumns({"long": F.contains("needle", F.lit(LONG_S)), "needle": T.fold_kin(F.col("needle"))})
    runs = words_of(F.col("needle"))
    # a title without an ASCII word goes by its first character
    key = F.when(F.size(runs) > 1, F.concat_ws(" ", F.slice(runs, 1, 2))).when(F.size(runs) == 1, runs[0]).otherwise(F.substring("needle", 1, 1))
    # a long s is an s of a title, but no word character beside it: titles with an s also meet every text that holds one
    keys = F.when(F.col("long"), F.array(F.lit(""))).when(F.contains("needle", F.lit("s")), F.array(key, F.lit(LONG_S))).otherwise(F.array(key))
    needles = needles.select("term", "pattern", F.explode(keys).alias("key"))
    # two versions of a document may share its name
    texts = docs.select(F.col("slug").alias("doc"), F.xxhash64("text").alias("version"), "text")
    # which kinds of keys there are: four at most
    kinds = {r["kind"] for r in needles.select(kind_of(F.col("key")).alias("kind")).distinct().collect()}
    pairs = texts.select("doc", "version", F.explode(keys_of(F.lower("text"), kinds)).alias("key")).join(needles, "key").select("doc", "version", "term", "pattern")
    return pairs.join(texts, ["doc", "version"]).where(F.expr("text rlike pattern")).select("term", "doc").distinct()


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0))


def kind_of(key: Column) -> Column:
    return F.when(key == LONG_S, "long").when(~key.rlike(ASCII_WORD), "odd").when(F.contains(key, F.lit(" ")), "pair").otherwise("word")


def keys_of(text: Column, kinds: set[str]) -> Column:
    """Distinct keys of a text, of the kinds asked for: ASCII words, pairs of them that follow each other, the long s, characters outside words and the empty string."""
    # a word beside a title's punctuation may go on outside ASCII, so words are ASCII runs on both sides
    two = lambda w: F.array_compact(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    keys = [F.array().cast("array<string>")]
    if "word" in kinds:
        keys.append(F.array_distinct(words_of(text)))
    if "pair" in kinds:
        keys.append(F.array_distinct(T.once(words_of(text), two)))
    if "long" in kinds:
        keys.append(F.when(F.contains(text, F.lit(LONG_S)), F.array(F.lit(LONG_S))).otherwise(F.array().cast("array<string>")))
    if "odd" in kinds:
        keys += [F.array(F.lit("")), F.array_remove(F.array_distinct(F.split(T.fold_kin(F.regexp_replace(text, "[a-z0-9_]+", "")), "")), "")]
    return F.concat(*keys)


def see_also(terms: DataFrame) -> DataFrame:
    """(src, dst, k) of the names a term refers to: by slug, else by title, where of equal titles the last counts."""
    by_title = terms.groupBy(F.lower("title").alias("low")).agg(F.max_by("slug", "ord").alias("by_title"))
    names = terms.select(F.col("slug").alias("src"), F.posexplode("related_names").alias("k", "name")).withColumn("by_slug_key", T.slugify(F.col("name")))
    slugs = terms.select(F.col("slug").alias("by_slug")).distinct()
    found = names.join(slugs, (F.col("by_slug") == F.col("by_slug_key")) & (F.col("by_slug") != F.col("src")), "left")
    found = found.join(by_title, F.lower("name") == F.col("low"), "left").withColumn("dst", F.coalesce("by_slug", "by_title"))
    return found.where("dst is not null and dst <> src").select("src", "dst", "k")


def ranked(edges: DataFrame, order: list, most: int) -> DataFrame:
    """(src, dst, rank) of the first ``most`` edges of each src, each dst once."""
    once = edges.groupBy("src", "dst").agg(F.min(F.struct(*order)).alias("o"))
    w = Window.partitionBy("src").orderBy("o")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("src", "dst", "rank")


def related_terms(terms: DataFrame, see: DataFrame | None = None, most: int = 12) -> DataFrame:
    """(src, dst, rank): see-also links, then mentions in order of the input, then backlinks of those, twice capped. terms: slug, title, text, ord."""
    ords = terms.select(F.col("slug"), F.col("ord"))
    mentions = mention_join(terms, terms.select("slug", "text"), 5, True).where("term <> doc").select(F.col("doc").alias("src"), F.col("term").alias("dst"))
    own = mentions.join(ords.withColumnRenamed("slug", "dst"), "dst").select("src", "dst", F.lit(1).alias("pass"), "ord")
    if see is not None:
        own = own.unionByName(see.select("src", "dst", F.lit(0).alias("pass"), F.col("k").cast("bigint").alias("ord")))
    first = ranked(own, ["pass", "ord"], most)
    back = first.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(ords.withColumnRenamed("slug", "dst"), "dst").select("src", "dst", F.lit(1).alias("pass"), "ord")
    return ranked(first.select("src", "dst", F.lit(0).alias("pass"), F.col("rank").cast("bigint").alias("ord")).unionByName(back), ["pass", "ord"], most)


def provenance(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc) of documents (slug, title, text) that mention a term in their text or title."""
    both = docs.select("slug", "text").union(docs.select("slug", F.col("title").alias("text")))
    return mention_join(terms, both)


def first_of(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


#: Terms of a set up to which all its subsets are listed.
FEW = 8


def key_of(terms: Column) -> Column:
    """Names a sorted array of terms."""
    text = F.array_join(terms, "\x1f")
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def subsets(terms: str) -> Column:
    """(key, shared) of each subset of an array of at most FEW terms, without the empty one."""
    chosen = F.expr(f"transform(sequence(1, shiftleft(1, size({terms})) - 1), m -> filter({terms}, (t, i) -> (shiftright(m, i) & 1) = 1))")
    return F.transform(chosen, lambda c: F.struct(key_of(c).alias("key"), F.size(c).cast("bigint").alias("shared")))


def by_subsets(asked: DataFrame, few: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """(own, c_src, dst, c_dst, o_dst, shared) of sets of few terms: whatever can be among the ``most`` of a set and collection.

    A document that shares the terms T with a set holds T. Of those that hold T and are no worse by collection, only the first
    can be needed; each set finds them by its own subsets. The largest subset under which a document is found is what
    they share, or others stand before it. So rows grow with the sets, not with pairs of them.
    """
    keys = few.select("own", F.explode(subsets("terms")).alias("s")).select("own", "s.key", "s.shared")
    holding = heads.join(keys.select(F.col("own").alias("other"), "key"), "other").select("key", "dst", "c_dst", "o_dst")
    by_collection = first_of(holding, ["key", "c_dst"], ["o_dst"], most).drop("place")
    # a document without a collection comes after all others, so it has a list of its own
    named = first_of(by_collection.where("c_dst is not null"), ["key"], ["o_dst"], most).drop("place")
    any_other = named.unionByName(by_collection.where("c_dst is null"))
    wish = asked.join(keys, "own")
    of_key = wish.select("key", "c_src").distinct()
    other = of_key.join(any_other, "key").where("not coalesce(c_src = c_dst, false)")
    same = of_key.join(by_collection.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("c_src") == F.col("c_dst"))).drop("k")
    best = first_of(other.unionByName(same).withColumn("same", (F.col("c_src") == F.col("c_dst")).cast("int")), ["key", "c_src"], [F.desc("same"), "o_dst"], most)
    best = best.select(F.col("key").alias("k"), F.col("c_src").alias("c"), "dst", "c_dst", "o_dst")
    met = wish.join(best, (F.col("key") == F.col("k")) & F.col("c_src").eqNullSafe(F.col("c")))
    return met.groupBy("own", "c_src", "dst", "c_dst", "o_dst").agg(F.max("shared").alias("shared"))


def by_pairs(asked: DataFrame, sets: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """The same of pairs of sets of which one has more than FEW terms: these meet on their terms."""
    terms = lambda rows: rows.select("own", F.explode("terms").alias("term"))
    many, few = sets.where(F.size("terms") > FEW), sets.where(F.size("terms") <= FEW)
    wanted = asked.select("own").distinct()
    of = lambda rows: terms(rows.join(wanted, "own", "left_semi"))
    met = of(sets).join(terms(many).withColumnRenamed("own", "other"), "term").unionByName(of(many).join(terms(few).withColumnRenamed("own", "other"), "term"))
    pairs = met.groupBy("own", "other").agg(F.count("*").alias("shared"))
    found = first_of(pairs.join(heads, "other"), ["own", "shared", "c_dst"], ["o_dst"], most).drop("other", "place")
    return asked.join(found, "own").select("own", "c_src", "dst", "c_dst", "o_dst", "shared")


def stored(rows: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, as several joins read them."""
    path = scratch(rows.sparkSession, "related")
    with plain_unions(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def related_docs(docs: DataFrame, mentions: DataFrame, most: int = 5, only: DataFrame | None = None) -> DataFrame:
    """(src, dst, shared, same, rank): by the number of shared terms, then the same collection, then the order of the input.

    Documents of one set of terms share as many terms with any other document, so sets are compared and not
    documents. Of a set's documents in a collection only the first can be needed, as they come by the order of the
    input. Sets of few terms meet by their subsets, others on their terms (``by_subsets``, ``by_pairs``). Of documents without a shared term only the first of the collection can be: each document
    takes as many of them as it may lack, never the whole. ``only`` (slug) restricts src, not dst.
    """
    d = docs.select("slug", "collection", "ord")
    sets = mentions.groupBy(F.col("doc").alias("slug")).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    own = stored(d.join(sets.withColumn("own", key_of(F.col("terms"))), "slug", "left"))
    sets = own.where("own is not null").groupBy("own").agg(F.first("terms").alias("terms"))
    own = own.drop("terms")
    wanted = own if only is None else own.join(only.select("slug"), "slug", "left_semi")
    # one more than asked for, as a document may stand in its own list
    heads = first_of(own.where("own is not null"), ["own", "collection"], ["ord"], most + 1)
    heads = heads.select(F.col("own").alias("other"), F.col("slug").alias("dst"), F.col("collection").alias("c_dst"), F.col("ord").alias("o_dst"))
    asked = wanted.where("own is not null").select("own", F.col("collection").alias("c_src")).distinct()
    found = by_subsets(asked, sets.where(F.size("terms") <= FEW), heads, most + 1).unionByName(by_pairs(asked, sets, heads, most + 1))
    same = (F.col("c_src") == F.col("c_dst")).cast("int")
    order = [F.desc("shared"), F.desc("same"), "o_dst"]
    lists = stored(first_of(found.withColumn("same", same), ["own", "c_src"], order, most + 1).drop("place"))
    lists = lists.withColumnRenamed("own", "of")
    src = wanted.select(F.col("slug").alias("src"), "own", "collection")
    shared = src.join(lists, (F.col("own") == F.col("of")) & F.col("collection").eqNullSafe(F.col("c_src"))).where("src <> dst").select("src", "dst", "shared", "same", "o_dst")
    # how far a document looks: what it lacks, itself, and those partners of its own that may stand in the way
    n_shared = shared.groupBy("src").agg(F.count("*").alias("n"))
    reach = src.join(n_shared, "src", "left").where(F.coalesce("n", F.lit(0)) < most).select("src", "collection", (F.lit(most + 1) + F.coalesce("n", F.lit(0))).alias("depth"))
    first = first_of(d, ["collection"], ["ord"], 2 * most).select(F.col("slug").alias("dst"), "collection", F.col("ord").alias("o_dst"), "place")
    tail = reach.join(first, "collection").where("place <= depth and src <> dst").join(shared, ["src", "dst"], "left_anti")
    tail = tail.select("src", "dst", F.lit(0).cast("bigint").alias("shared"), F.lit(1).alias("same"), "o_dst")
    return first_of(shared.unionByName(tail), ["src"], order, most).select("src", "dst", "shared", "same", F.col("place").alias("rank"))

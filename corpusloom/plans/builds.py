"""Registered queries of the corpus build, of an earlier state of the tables that is brought up to date, and of the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import atlas, corpus, layout
from corpusloom.operators.textindex import TextIndex
from corpusloom.plans.catalogue import DOCS, MENTIONS, POINTS, TERM_MENTIONS, TERMS, _ranked, points, q_trim, query, sources, table, terms
from corpusloom.plans.catalogue import corpus as search_corpus
from corpusloom.sources import tables
from corpusloom.sources.generations import Generation, Generations, scratch

#: Later terms that each term names as see-also: more than the cap of links.
NAMED = 15


def named_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms with the titles of the next ones as see-also names, met by their number in the input."""
    rows = terms(spark, sf_dir)
    later = rows.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(NAMED)), lambda i: F.col("ord") - i)).alias("i", "ord"), F.col("title").alias("name"))
    names = later.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("related_names"))
    rows = rows.join(names, "ord", "left").withColumn("related_names", F.coalesce("related_names", F.array().cast("array<string>")))
    return corpus.placed(rows, 0, F.col("ord"))


def placed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.placed(sources(spark, sf_dir), 1, F.col("ord"))


def updated(spark: SparkSession, sf_dir: str) -> Generation:
    """A generation of an earlier state, and after it that of the tables: toxic documents came later, those of low quality were empty, pages were removed, some titles were others."""
    now_terms, now = named_terms(spark, sf_dir), placed_sources(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("slug"), "quality", "toxic").dropDuplicates(["slug"])
    was = now.join(labels, "slug", "left").where("coalesce(toxic, 0) = 0")
    was = was.withColumns({c: F.when(F.col("quality") == 0, F.lit("")).otherwise(F.col(c)) for c in ("title", "text")}).select(*now.columns)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("slug"), F.col("url").alias("title"), F.lit("pages").alias("collection"), F.lit("page").alias("kind"), F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", " ").alias("text"), F.col("page_id").alias("ord"))
    was = was.unionByName(corpus.placed(pages, 0, F.col("ord")).select(*was.columns))
    was_terms = now_terms.withColumn("title", F.when(F.length("text") > 250, T.first_sentences(F.col("text"))).otherwise(F.col("title")))
    store = Generations(spark, scratch(spark, "generations"))
    corpus.build(store, was_terms, was)
    return corpus.build(store, now_terms, now)


LINKED = f"""{TERM_MENTIONS.replace(TERMS, MENTIONS)},
bt AS (SELECT lower(title) AS low, arg_max(slug, ord) AS slug FROM t GROUP BY 1),
tx AS (SELECT *, CAST(regexp_replace(slug, '^item-', '') AS BIGINT) AS i FROM t),
sa AS (SELECT a.slug AS src, bt.slug AS dst, b.i - a.i AS k FROM tx a JOIN tx b ON b.i - a.i BETWEEN 1 AND {NAMED} JOIN bt ON bt.low = lower(b.title) WHERE bt.slug <> a.slug),
le AS (SELECT src, dst, min((p, o)) AS way FROM (SELECT src, dst, 0 AS p, k AS o FROM sa UNION ALL SELECT src, dst, 1, dst_ord FROM tm) GROUP BY src, dst),
f12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY way) AS r FROM le) WHERE r <= 12),
bk AS (SELECT src, dst, min((p, o)) AS way FROM (SELECT src, dst, 0 AS p, r AS o FROM f12 UNION ALL SELECT f12.dst, f12.src, 1, t.ord FROM f12 JOIN t ON t.slug = f12.src) GROUP BY src, dst),
rt AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY way) AS rank FROM bk),
sh AS (SELECT a.doc AS src, b.doc AS dst, count(*) AS shared FROM m a JOIN m b ON a.term = b.term AND a.doc <> b.doc GROUP BY 1, 2),
pd AS (SELECT a.slug AS src, b.slug AS dst, coalesce(sh.shared, 0) AS shared, CAST(coalesce(a.collection = b.collection, false) AS INTEGER) AS same, b.ord AS o FROM s a JOIN s b ON a.slug <> b.slug LEFT JOIN sh ON sh.src = a.slug AND sh.dst = b.slug WHERE sh.shared > 0 OR a.collection = b.collection),
rd AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY shared DESC, same DESC, o) AS rank FROM pd)"""


@query(f"""WITH {LINKED} SELECT 'provenance' AS kind, term AS src, doc AS dst, CAST(NULL AS INTEGER) AS rank FROM m
UNION ALL SELECT 'related_term', src, dst, CAST(rank AS INTEGER) FROM rt WHERE rank <= 12
UNION ALL SELECT 'related_doc', src, dst, CAST(rank AS INTEGER) FROM rd WHERE rank <= 5""")
def corpus_links_updated(spark, sf):
    return corpus.edges(updated(spark, sf))


@query(f"""WITH {LINKED} SELECT t.slug, t.title, (SELECT string_agg(dst, ',' ORDER BY rank) FROM rt WHERE rt.src = t.slug AND rank <= 12) AS related,
(SELECT string_agg(m.doc, ',' ORDER BY s.ord) FROM m JOIN s ON s.slug = m.doc WHERE m.term = t.slug) AS provenance FROM t""")
def corpus_terms_built(spark, sf):
    store = Generations(spark, scratch(spark, "generations"))
    built, _ = corpus.records(corpus.build(store, named_terms(spark, sf), placed_sources(spark, sf)))
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return built.select("slug", "title", joined("related"), joined("provenance"))


# -- the stored index


def stored_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex.build(search_corpus(spark, sf_dir), scratch(spark, "index"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


@query(_ranked("the tion", False, False))
def index_search_exact(spark, sf):
    return _rounded(stored_index(spark, sf).search("the tion", 40, False, False).rows).select("id", "score")


@query(_ranked("theter reing", True, True))
def index_search_fuzzy(spark, sf):
    return _rounded(stored_index(spark, sf).search("theter reing").rows).select("id", "score")


SNIPPET = q_trim("substr(text, greatest(strpos(lower(text), 'the') - 61, 0) + 1, 220)")


@query(f"""WITH {DOCS}, w AS ({_ranked("the onth", True, True)})
SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, title, CASE WHEN kind = 'term' THEN 'Dictionary' ELSE collection END AS badge, url, score,
replace(replace(replace(CASE WHEN strpos(lower(text), 'the') > 61 THEN '…' ELSE '' END || {SNIPPET}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '…' AS snippet FROM w JOIN d USING (id)""")
def index_hits(spark, sf):
    return _rounded(stored_index(spark, sf).hits("the onth"))


# -- the map's file


def map_file(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and edges written as the page's file and read back; further coordinates are further components."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v:"), F.col("vec_id")).alias("id"), *(F.round(F.col("embedding")[i].cast("double"), 4).alias(n) for i, n in ((2, "x3"), (3, "y3"), (4, "z3"))))
    p = points(spark, sf_dir).join(e, "id").withColumn("url", F.concat(F.lit("/p/"), "id"))
    links = p.select(F.col("id").alias("source"), F.concat(F.lit("v:"), F.col("ord") + 1).alias("target"), F.lit("discussed-in").alias("kind"))
    path = f"{scratch(spark, 'map')}/atlas.json"
    tables.write_atlas(p, atlas.edges_between(links, p), path)
    return tables.read_atlas(spark, path)


@query(f"""WITH {POINTS} SELECT pt.id, type, title, CAST(NULL AS VARCHAR) AS subtitle, x2, y2, round(CAST(embedding[3] AS DOUBLE), 4) AS x3, round(CAST(embedding[4] AS DOUBLE), 4) AS y3, round(CAST(embedding[5] AS DOUBLE), 4) AS z3, '/p/' || pt.id AS url
FROM pt JOIN embeddings e ON e.vec_id = pt.ord""")
def map_file_points(spark, sf):
    return map_file(spark, sf)[0]


@query(f"WITH {POINTS} SELECT a.id AS source, b.id AS target, 'discussed-in' AS kind FROM pt a JOIN pt b ON b.ord = a.ord + 1")
def map_file_edges(spark, sf):
    return map_file(spark, sf)[1]


# -- the map's layout; a sampled descent has no SQL, tests/test_layout.py holds its parts to brute force


@query()
def atlas_layout_neighbours(spark, sf):
    places = layout.neighbour_layout(table(spark, sf, "embeddings"))
    return places.select("vec_id", *(F.col("p")[i].alias(n) for i, n in enumerate(("x2", "y2", "x3", "y3", "z3"))))

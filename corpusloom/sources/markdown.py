"""Folders of Markdown files as DataFrames, and back: one file is one row, its stem the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as fm
from corpusloom.functions import text as T
from corpusloom.schema import SOURCES, TERMS, enforce_schema


def read_folder(spark: SparkSession, path: str, prefix: str = "", skip_underscore: bool = True, optional: bool = False) -> DataFrame:
    """slug, text, ord: files *.md, in byte order of their names with the ending; a missing folder, if optional, gives no rows."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], "slug string, text string, ord bigint")
    rows = spark.read.option("pathGlobFilter", f"{prefix}*.md").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    if skip_underscore:
        rows = rows.where(~F.startswith("name", F.lit("_")))
    name = F.try_url_decode(F.col("name"))
    rows = rows.withColumn("name", F.coalesce(name, F.col("name")))
    # one order over file names, a few bytes each; texts aren't sorted with them
    order = rows.select("name").withColumn("ord", F.row_number().over(Window.orderBy("name")).cast("bigint"))
    return rows.join(order, "name").select(F.substring("name", len(prefix) + 1, 10_000).alias("n"), "text", "ord").select(F.regexp_replace("n", r"\.md\z", "").alias("slug"), "text", "ord")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """name, text: one file of any ending as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def parse_posts(files: DataFrame, collection: str, kind: str, default_date: str | None = None, author: str | None = None, compat: bool = False, own_slug: bool = True) -> DataFrame:
    """Rows of the sources' schema from files with headers; the body loses its own title and address lines.

    The slug is the file's name or, without own_slug, that of the collection and the header's slug or the name.
    """
    from corpusloom.operators.split import post

    rows = files.withColumn("s", fm.split_header(F.col("text"))).select("slug", "ord", F.col("s.header").alias("header"), F.col("s.body").alias("body"))
    field = lambda k: fm.scalar(F.col("header"), k, compat)
    body = post(F.col("body"))
    slug = F.col("slug") if own_slug else F.concat_ws("-", T.slugify(F.lit(collection)), T.slugify(F.coalesce(field("slug"), F.col("slug"))))
    return rows.select(
        slug.alias("slug"), T.title_or_name(field("title"), F.col("slug")).alias("title"), F.coalesce(field("subtitle"), F.lit("")).alias("subtitle"), F.lit(collection).alias("collection"), F.lit(kind).alias("kind"), F.lit(0).alias("order"),
        F.coalesce(field("date"), F.lit(default_date)).alias("date"), F.coalesce(field("author"), F.lit(author)).alias("author"), F.coalesce(field("url"), field("original_url")).alias("original_url"),
        T.first_sentences(body).alias("excerpt"), T.word_count(body).cast("int").alias("word_count"), fm.tags(F.lit(collection), fm.listed(F.col("header"), "tags", compat), compat).alias("tags"), body.alias("body_md"), "ord",
    )


def parse_terms(files: DataFrame, compat: bool = False) -> DataFrame:
    """Rows of the terms' schema from files of terms whose bodies are HTML already.

    The letter is the header's, if it has one of A to Z, else that of the title; the origin may be called source.
    """
    rows = files.withColumn("s", fm.split_header(F.col("text"))).select("slug", "ord", F.col("s.header").alias("header"), T.trim(F.col("s.body")).alias("body_html"))
    field = lambda k: fm.scalar(F.col("header"), k, compat)
    many = lambda k: fm.items(F.col("header"), k, compat)
    given, one = field("letter"), field("tags")
    letter = F.when(given.rlike("[A-Z]"), given).otherwise(T.letter(F.coalesce(field("title"), F.col("slug"))))
    tags = F.when((F.size(many("tags")) > 0) | one.isNull() | one.rlike(r"\A\["), many("tags")).otherwise(F.array(one))
    origin = F.coalesce(field("origin"), field("source"), F.lit(""))
    return enforce_schema(rows.select(
        "slug", letter.alias("letter"), T.title_or_name(field("title"), F.col("slug")).alias("title"), F.coalesce(field("subtitle"), F.lit("")).alias("subtitle"), field("theme").alias("theme"),
        field("authored_by").alias("authored_by"), origin.alias("origin"), origin.alias("source"), many("related").alias("related_names"), many("provenance").alias("provenance"), tags.alias("tags"),
        field("link").alias("link"), field("link_label").alias("link_label"), "body_html", F.regexp_replace("body_html", "<[^>]+>", " ").alias("body_text"), "ord",
    ), TERMS)


def render_terms(terms: DataFrame, authored_by: str) -> DataFrame:
    """slug, text: each term as a file with a header; empty fields are left out."""
    c, filled = F.col, lambda n: (n, F.nullif(F.col(n), F.lit("")), "string")
    fields = [("letter", c("letter"), "string"), ("title", c("title"), "string"), filled("subtitle"), filled("theme"), ("authored_by", F.lit(authored_by), "string"), filled("origin"), ("source", F.coalesce("origin", F.lit("")), "string")]
    fields += [(n, F.coalesce(n, F.array().cast("array<string>")), "list") for n in ("related", "provenance", "tags")] + [filled("link"), filled("link_label")]
    return terms.select("slug", F.concat(fm.render(fields), F.lit("\n\n"), F.coalesce("body_html", F.lit("")), F.lit("\n")).alias("text"))


def render_sources(sources: DataFrame) -> DataFrame:
    """slug, text: each row as a file with a header."""
    c = F.col
    fields = [(n, c(n), "string") for n in ("title", "subtitle", "collection", "kind")] + [("order", c("order"), "number")] + [(n, c(n), "string") for n in ("date", "author", "original_url", "excerpt")] + [("word_count", c("word_count"), "number"), ("tags", c("tags"), "list"), ("related", c("related"), "list")]
    return sources.select("slug", F.concat(fm.render(fields), F.lit("\n\n"), T.trim(c("body_md")), F.lit("\n")).alias("text"))


def write_files(files: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """One file per row, by the tasks that hold the rows; (slug, bytes, path). With dry_run nothing is written."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:///{path}")
        for pdf in batches:
            out = []
            for slug, text in zip(pdf["slug"], pdf["text"], strict=True):
                data = text.encode()
                if not dry_run:
                    system.create_dir(root, recursive=True)
                    with system.open_output_stream(f"{root}/{slug}.md") as f:  # a repeated task writes the same file again
                        f.write(data)
                out.append((slug, len(data), f"{root}/{slug}.md"))
            yield pd.DataFrame(out, columns=["slug", "bytes", "path"])

    return files.mapInPandas(run, "slug string, bytes bigint, path string")


def rewrite(files: DataFrame, path: str) -> int:
    """The folder holds the files and nothing else, afterwards; their number.

    They are written to a folder beside it, which takes its place when all tasks are done: a run that fails leaves
    the old files. files may be read from the folder itself.
    """
    spark, beside = files.sparkSession, path.rstrip("/") + ".new"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = hadoop(beside), hadoop(path)
    system = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(new, True)
    system.mkdirs(new)
    n = write_files(files, beside).agg(F.count("slug")).first()[0]
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{beside} can't be renamed")
    return n


def refresh(terms: DataFrame, sources: DataFrame, path: str, authored_by: str) -> DataFrame:
    """Rewrites path/terms and path/sources; one row with the number of files of each."""
    counts = rewrite(render_terms(terms, authored_by), f"{path}/terms"), rewrite(render_sources(enforce_schema(sources, SOURCES)), f"{path}/sources")
    return terms.sparkSession.createDataFrame([counts], "terms bigint, sources bigint")

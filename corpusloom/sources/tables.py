"""Other sources and sinks: slug lists, JSON, ledgers, upserts and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def read_slugs(spark: SparkSession, path: str) -> DataFrame:
    """slug, date, word_count, type, title of a tab-separated list; blank lines, comments and the header go."""
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r", ""), "\t").alias("c")).where(T.trim(F.col("c")[0]) != "")
    rows = rows.where(~F.startswith(F.col("c")[0], F.lit("#")) & (F.col("c")[0] != "slug"))
    return rows.select(*(T.trim(F.get("c", i)).alias(n) for i, n in enumerate(("slug", "date", "word_count", "type", "title"))))


POST = "slug string, title string, subtitle string, post_date string, wordcount bigint, canonical_url string, body_html string, type string, podcast_duration string, podcast_url string, postTags array<string>"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POST).option("multiLine", True).json(path)


def write_json_lines(docs: DataFrame, path: str) -> None:
    """Search documents as lines of JSON, by all tasks."""
    docs.write.mode("overwrite").json(path)


def write_json_array(docs: DataFrame, path: str) -> int:
    """One file with one array, as a page loads it; the number of its elements. A single task streams the rows."""

    def write(batches):
        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        n = 0
        with system.open_output_stream(target) as f:
            f.write(b"[")
            for pdf in batches:
                for line in pdf["line"]:
                    f.write((b",\n" if n else b"") + line.encode())
                    n += 1
            f.write(b"]")
        return n

    def run(batches):
        import pandas as pd

        yield pd.DataFrame({"n": [write(batches)]})

    lines = docs.select(F.to_json(F.struct(*docs.columns)).alias("line")).coalesce(1)
    n = lines.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0]
    return write([]) if n is None else n  # a plan known to be empty has no task


SEARCH_DOC = "id string, kind string, slug string, title string, subtitle string, collection string, url string, text string"
POINT = "id string, type string, title string, subtitle string, x3 double, y3 double, z3 double, x2 double, y2 double, url string"
EDGE = "source string, target string, kind string"
ATLAS = f"points array<struct<{POINT}>>, edges array<struct<{EDGE}>>, stats struct<terms bigint, sources bigint, edges bigint>"


def read_search_docs(spark: SparkSession, path: str) -> DataFrame:
    """Search documents from one array or from lines."""
    return spark.read.schema(SEARCH_DOC).option("multiLine", True).json(path) if path.endswith(".json") else spark.read.schema(SEARCH_DOC).json(path)


def read_atlas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and edges of a map's JSON, with coordinates and kinds."""
    whole = spark.read.schema(ATLAS).option("multiLine", True).json(path)
    return whole.select(F.inline("points")), whole.select(F.inline("edges"))


def read_atlas_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: terms, sources, edges."""
    return spark.read.schema(ATLAS).option("multiLine", True).json(path).select("stats.*")


def saved_slugs(spark: SparkSession, path: str) -> set[str]:
    """Slugs of posts fetched earlier: at most as many as one reader fetched one by one, with a pause."""
    from corpusloom.sources.markdown import exists

    if not exists(spark, path):
        return set()
    return {r["slug"] for r in spark.read.parquet(path).where("ok").select("slug").distinct().toLocalIterator()}


def write_atlas(points: DataFrame, edges: DataFrame, path: str) -> None:
    """One file as the map's page loads it: points, edges and the counts of terms, sources and edges, as compact JSON.

    points and edges have the columns of POINT and EDGE and perhaps others, which are left out; nulls are written. They
    are in the order of a column ord, where they have one, then of their text. A single task sorts them and streams them
    into the file.
    """
    kinds = points.agg(F.count_if(F.col("type") == "term").alias("terms"), F.count_if(F.col("type") == "source").alias("sources")).first()
    stats = {"terms": kinds["terms"], "sources": kinds["sources"], "edges": edges.agg(F.count("*")).first()[0]}
    order = lambda df: F.lit("") if "ord" not in df.columns else F.col("ord") if dict(df.dtypes)["ord"] == "string" else F.lpad(F.col("ord").cast("string"), 20, "0")
    line = lambda df, kind, part: df.select(F.lit(part).alias("part"), order(df).alias("ord"), F.to_json(F.struct(*(f.split()[0] for f in kind.split(", "))), {"ignoreNullFields": "false"}).alias("line"))
    lines = line(points, POINT, 0).union(line(edges, EDGE, 1)).coalesce(1).sortWithinPartitions("part", "ord", "line").select("part", "line")

    def write(batches):
        import json

        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        system.create_dir(target.rpartition("/")[0], recursive=True)
        part, n = 0, 0
        with system.open_output_stream(target) as f:
            f.write(b'{"points":[')
            for pdf in batches:
                for which, text in zip(pdf["part"], pdf["line"], strict=True):
                    if which != part:
                        f.write(b'],"edges":[')
                        part, n = which, 0
                    f.write((b"," if n else b"") + text.encode())
                    n += 1
            f.write((b'],"edges":[' if part == 0 else b"") + b'],"stats":' + json.dumps(stats, separators=(",", ":")).encode() + b"}")

    def run(batches):
        import pandas as pd

        write(batches)
        yield pd.DataFrame({"done": [True]})

    if lines.mapInPandas(run, "done boolean").first() is None:
        write([])  # a plan known to be empty has no task


def ledger_rows(failures: DataFrame, at: Column, most: int = 300) -> DataFrame:
    """at, slug, reason of failures: one line each, the reason cut."""
    return failures.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "slug", F.substring(T.collapse(F.col("reason")), 1, most).alias("reason"))


def append_ledger(failures: DataFrame, path: str, at: Column | None = None, most: int = 300) -> None:
    ledger_rows(failures, F.current_timestamp() if at is None else at, most).write.mode("append").option("sep", "\t").csv(path)


def upsert(have: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Rows of new, and those of have whose key is not among them."""
    return new.unionByName(have.join(new.select(key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def report(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of named counters."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in counters.items()))

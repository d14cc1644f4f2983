"""Documents split into records at heading lines: a running count of the headings numbers the groups.

The window runs within a document, so documents are spread over tasks; a document is as long as its longest file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))


def sections(docs: DataFrame, is_heading: Column, key: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """key, section (from 1), heading, body, and what carry names: for each the last value not null so far. Lines before the first heading are dropped."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines_of(docs, key, text)
    rows = rows.select("*", is_heading.alias("_h"), *(c.alias(n) for n, c in (carry or {}).items()))
    rows = rows.select(key, "pos", "line", "_h", F.sum(F.col("_h").cast("int")).over(w).alias("section"), *(F.last(n, ignorenulls=True).over(w).alias(n) for n in carry or {}))
    at_heading = lambda n: F.max(F.when(F.col("_h"), F.col(n))).alias(n)
    grouped = rows.where("section > 0").groupBy(key, "section").agg(
        F.max(F.when(F.col("_h"), F.col("line"))).alias("heading"), *(at_heading(n) for n in carry or {}),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    return grouped


def lexicon(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Dictionary entries of Markdown: ``## theme`` sets the theme, ``### term · gloss`` opens an entry; rules are dropped."""
    line = F.col("line")
    theme = F.when(line.rlike(r"^##[ \t]+[^#]"), F.regexp_extract(line, r"^##[ \t]+(?:[IVXLC]+\.[ \t]+)?(.*\S)[ \t]*$", 1))
    is_entry = line.rlike(r"^###[ \t]+\S")
    found = sections(docs, is_entry, key, text, {"theme": theme})
    body = F.regexp_replace(F.regexp_replace(F.col("body"), r"(?m)^##[ \t]+.*$", ""), r"(?m)^---[ \t]*$", "")
    origin = F.try_element_at(F.regexp_extract_all(body, F.lit(r"(?im)^\*Origin\.\*[ \t]*(.+)$"), F.lit(1)), F.lit(-1))
    see = F.regexp_extract_all(body, F.lit(r"(?im)^\*See also:\*[ \t]*(.+)$"), F.lit(1))
    names = F.filter(F.transform(F.flatten(F.transform(see, lambda s: F.split(s, "[,;]"))), lambda n: T.trim(F.regexp_replace(n, "[.\"']+\\z", ""))), lambda n: n != "")
    parts = F.split(F.regexp_replace(F.col("heading"), r"^###[ \t]+", ""), rf"{T.WS}+·{T.WS}+")
    title = T.chain(T.trim(parts[0]), ('\\A"', ""), ('"\\z', ""))
    clean = T.trim(T.chain(body, (r"(?im)^\*(?:Origin\.|See also:)\*.*$", ""), (r"\n{3,}", "\n\n")))
    rows = found.select(key, F.col("section").alias("ord"), title.alias("title"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " · ").alias("subtitle"), F.coalesce("theme", F.lit("")).alias("theme"), F.coalesce(T.trim(origin), F.lit("")).alias("origin"), names.alias("related_names"), clean.alias("body"))
    rows = rows.withColumn("slug", T.slugify(F.col("title"))).where("slug <> ''")
    tags = F.filter(F.array(F.lit("dialect"), T.theme_tag(F.col("theme"))), lambda t: t != "")
    return rows.select(key, "ord", "slug", T.letter(F.col("title")).alias("letter"), "title", "subtitle", "theme", "origin", "related_names", tags.alias("tags"), T.md_block(F.col("body")).alias("body_html"), F.regexp_replace("body", "[#*_>`]", " ").alias("body_text"))


def book(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400, compat: bool = False) -> DataFrame:
    """Sections of a book at ``Part ROMAN:`` and ``Chapter N:`` lines of more than ``least`` characters; tables of contents and page marks are dropped.

    With compat also blank lines, and lines of up to four characters that could be a page number, go.
    """
    line = T.trim(F.col("line"))
    contents = line.rlike(r"\.{5,}") | (line.rlike(r"[0-9]+\z") & line.rlike(r"\.{3,}") & (F.length(line) < 90))
    part = line.rlike(r"^Part\s+[IVXLC]+:\s*\S") & ~contents
    chapter = line.rlike(r"^Chapter\s+[0-9]+:\s*\S") & ~contents
    marks = r"(?m)^\[PAGE[ \t]+[0-9]+\][ \t]*$\n?"
    numbers = r"(?im)^[ \t]*(?=[ivxlcdm0-9])[ivxlcdm]{0,7}[0-9]{0,4}[ \t]*$\n?"
    cleaned = docs.withColumn(text, T.chain(F.col(text), (marks, ""), (numbers, "")))
    if compat:
        cleaned = cleaned.withColumn(text, F.regexp_replace(text, r"(?m)^[ \t]*\n", ""))
    found = sections(cleaned, part | chapter, key, text, {"part": F.when(part, line)})
    found = found.where(F.length(F.replace("body", F.lit("\n"), F.lit(""))) > least)
    title = T.trim(F.col("heading"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("section"))
    return found.select(key, order.alias("order"), title.alias("title"), F.when(F.col("part") != title, F.col("part")).otherwise("").alias("subtitle"), T.slugify(title).alias("slug"), T.trim(F.regexp_replace("body", r"\n{3,}", "\n\n")).alias("body"))


def post(raw: Column) -> Column:
    """A post's body without its leading title and address lines."""
    return T.trim(T.chain(raw, (r"\A#\s+.+\n+", ""), (r"(?im)^\*\*(?:Original URL|Published):\*\*.*$", "")))


def draft_title(raw: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"(?m)^#[ \t]+(.+)$", 1), F.lit("")), F.lit(otherwise))

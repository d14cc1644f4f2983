"""Schemas of the two collections, and how rows are made to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "array<string>": T.ArrayType(T.StringType())}


def struct(fields: str) -> T.StructType:
    """Of "name kind, ..."; unlike the DDL parser it needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


TERMS = struct(
    "slug string, letter string, title string, subtitle string, theme string, authored_by string, origin string, source string, related array<string>, provenance array<string>, "
    "tags array<string>, link string, link_label string, related_names array<string>, body_html string, body_text string, ord bigint"
)
SOURCES = struct(
    "slug string, title string, subtitle string, collection string, kind string, order int, date string, author string, original_url string, excerpt string, word_count int, "
    "tags array<string>, related array<string>, body_md string, ord bigint"
)
#: Values where a row has none; those of a site's author are parameters.
DEFAULTS = {"source": "", "order": 0, "excerpt": "", "word_count": 0}


def enforce_schema(df: DataFrame, schema: T.StructType, **defaults: object) -> DataFrame:
    """The schema's columns in their order: missing ones null, arrays empty, others by DEFAULTS and what is given."""
    given, out = DEFAULTS | defaults, []
    for field in schema.fields:
        c = F.col(f"`{field.name}`").cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(field.dataType))
        elif field.name in given:
            c = F.coalesce(c, F.lit(given[field.name]).cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)


def rejected(df: DataFrame, required: tuple[str, ...] = ("slug", "title")) -> DataFrame:
    """slug and missing: rows without a value in a required column, and which; a run that must not go on counts them."""
    lacking = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in required)))
    return df.select("slug", lacking.alias("missing")).where(F.size("missing") > 0)

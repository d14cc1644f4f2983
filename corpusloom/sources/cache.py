"""Pages kept beside a run: what was fetched once isn't fetched again, and pages without pictures are marked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is kept of a post beside its HTML.
META = ("title", "post_date", "cover_image", "canonical_url")


def read_through(wanted: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str = "slug", body: str = "html") -> DataFrame:
    """Rows of the cache, or of fetch(keys) where it has none or an empty body; ``fetched`` tells which."""
    keys = wanted.select(key).distinct()
    hits = cache.where(F.length(body) > 0).join(keys, key, "left_semi")
    found = fetch(keys.join(hits.select(key), key, "left_anti"))
    return hits.withColumn("fetched", F.lit(False)).unionByName(found.withColumn("fetched", F.lit(True)), allowMissingColumns=True)


def side_meta(posts: DataFrame) -> DataFrame:
    """slug, meta: a line of JSON with the fields of META, null ones too."""
    fields = [F.col(n) if n in posts.columns else F.lit(None).cast("string").alias(n) for n in META]
    return posts.select("slug", F.to_json(F.struct("slug", *fields), {"ignoreNullFields": "false"}).alias("meta"))


def without_images(pages: DataFrame, slots: DataFrame, key: str = "slug") -> DataFrame:
    """Keys of pages with a body in which no picture was found: the marks that later runs skip."""
    return pages.where("html is not null").select(key).distinct().join(slots.select(key), key, "left_anti")


def to_visit(wanted: DataFrame, cache: DataFrame, marks: DataFrame, key: str = "slug") -> DataFrame:
    """Wanted rows but those both cached and marked."""
    done = cache.select(key).join(marks.select(key), key, "left_semi")
    return wanted.join(done, key, "left_anti")

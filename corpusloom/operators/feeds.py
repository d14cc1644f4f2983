"""Feeds of records, where the first feed that has a key wins, and parsers that are registered by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSERS: dict[str, Callable[..., DataFrame]] = {}


def register_parser(name: str, parser: Callable[..., DataFrame]) -> None:
    """parser(spark, **options) gives the rows of a feed."""
    PARSERS[name] = parser


def load_feed(spark: SparkSession, name: str, **options: object) -> DataFrame:
    return PARSERS[name](spark, **options)


def first_wins(*feeds: DataFrame, key: str = "slug") -> DataFrame:
    """All rows of the first feed, then of each other the rows whose key no earlier feed has."""
    return reduce(lambda have, more: have.unionByName(more.join(have.select(key), key, "left_anti").select(*more.columns), allowMissingColumns=True), feeds)


def last_write(rows: DataFrame, key: str = "slug", order: str = "ord") -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("last"))
    return last.select("last.*")


def missing_only(wanted: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    """What is still to do."""
    return wanted.join(done.select(key), key, "left_anti")


def split_list(text: str) -> list[str]:
    """Items of a comma-separated option."""
    return [x.strip() for x in text.split(",") if x.strip()]

"""A corpus in four stages, each over all rows that its predecessor kept: language ID, near duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import language, near_dup, packing, pii
from corpusloom.llm.common import discard, materialise, table

#: Begins the names of columns that a stage adds for itself.
OWN = "corpusloom_"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter, or far from every language, go."""
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs, model, keep=docs.columns, prefix=OWN)
    return found.where(f"not {OWN}rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Of rows that repeat an id and its text one stays; rows without an id are in no group and stay.
    """
    found = materialise(near_dup.near_duplicates(docs).where("doc_id is not null"), "groups")
    kept = found.where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        own = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
        rows = rows.withColumn(f"{OWN}place", F.row_number().over(own)).where(f"{OWN}place = 1")
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data in their texts replaced; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack_documents(docs, packing.default_vocabulary())


#: name and function of each stage: (spark, docs, sf_dir) -> DataFrame
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the sketches; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, docs = given, materialise(docs, name)
            discard(before)
    return docs

"""Language ID by the nearest of several centroids per language.

A text becomes a vector of hashed character n-grams (1 to 3 letters, lower case, everything else a
space), weighted by log(1 + count) * idf and scaled to length 1. Each language has up to CENTROIDS
centroids, found by spherical k-means. A text gets the language of the centroid of the greatest
cosine; it is rejected where even that one is further away than texts of its length and language are.
Every length class has such a radius: short classes without enough texts take pieces of longer ones, long
classes that of the nearest shorter class, as the cosine rises with the length, and languages with too
few texts for any the least of the other languages.

Document frequencies count all training rows, aggregated per task before they are shuffled. Centroids
and radii are fitted to at most SAMPLE rows per language, drawn by a hash of id and text, a language per
task. To the driver come DIMENSIONS frequencies and the centroids, neither of which grows with the rows.
Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bpe import portions
from corpusloom.llm.common import table

#: Hashed n-grams; centroids of a language; rows of a language that they are fitted to; rounds of k-means.
DIMENSIONS, CENTROIDS, SAMPLE, ROUNDS = 8192, 4, 600, 12
#: Languages that rows may be labelled with; the centroids of all are held at once.
MAX_LANGUAGES = 512
#: A text is rejected below this share of the QUANTILE of the cosines of the sample's texts of its length.
SHARE, QUANTILE = 0.6, 0.01
#: Texts or pieces of a language and length that a radius takes at least.
EVIDENCE = 5
#: Length classes.
CLASSES = 32
UNKNOWN = "und"
#: Vectors that are compared at a time.
ROWS = 256


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.where(is_letter, codes, 32).astype(np.uint32)
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    a, b = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
    one = a[1:-1] ^ np.uint32(0x1B873593)
    two = a[:-1] + b[1:]
    three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:]
    h = np.concatenate([one, two * np.uint32(0x27D4EB2F), three])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - (DIMENSIONS.bit_length() - 1))).astype(np.int64)


def counts(text: str) -> np.ndarray:
    return np.bincount(grams(text), minlength=DIMENSIONS)


def vectors(found: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.stack(found).astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def bucket(n: np.ndarray | int) -> np.ndarray | int:
    """Length class of a number of n-grams."""
    return np.log2(np.maximum(n, 1)).astype(np.int64) if isinstance(n, np.ndarray) else int(np.log2(max(n, 1)))


def pieces(text: str, enough: set[int]) -> Iterator[np.ndarray]:
    """Counts of the starts of a text, about one for each shorter length class that hasn't enough texts, cut between words where they can be."""
    text = text.lstrip()
    for b in range(2, CLASSES):
        n = 1 << (b - 1)  # three n-grams a letter: 1.5 times the least of the class
        if n >= len(text):
            return
        if b in enough:
            continue
        at = n if text[n].isspace() else max(text.rfind(" ", 0, n), 0) or n
        yield counts(text[:at])


def radii(near: np.ndarray, size: np.ndarray, shorter: np.ndarray, shorter_size: np.ndarray) -> list[float]:
    """Least cosine by length class, from the cosines and classes of texts and of pieces of texts; all NaN without evidence for any class."""
    least = np.full(CLASSES, np.nan)
    for b in range(CLASSES):
        found = near[size == b]
        if len(found) < EVIDENCE:
            found = np.concatenate([found, shorter[shorter_size == b]])
        if len(found) >= EVIDENCE:
            least[b] = SHARE * np.quantile(found, QUANTILE)
    known = np.flatnonzero(~np.isnan(least))
    if len(known):
        for b in range(CLASSES):
            if np.isnan(least[b]):
                least[b] = least[known[known < b].max() if (known < b).any() else known.min()]
    return least.tolist()


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # a row each
    least: np.ndarray  # cosine below which a text is rejected, by centroid and length class
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language, cosine and whether it is rejected; UNKNOWN, 0 and True for a text that is null or has no letter."""
        for at in range(0, len(texts), ROWS):
            found = [counts(t or "") for t in texts[at : at + ROWS]]
            sizes = np.array([x.sum() for x in found])
            if not self.languages:
                yield from [(UNKNOWN, 0.0, True)] * len(found)
                continue
            cosines = vectors(found, self.idf) @ self.centroids.T
            best = cosines.argmax(1)
            for i, k in enumerate(best.tolist()):
                if not sizes[i]:
                    yield UNKNOWN, 0.0, True
                    continue
                score = float(min(1.0, max(0.0, cosines[i, k])))
                yield self.languages[k], score, bool(score < self.least[k, min(bucket(int(sizes[i])), self.least.shape[1] - 1)])


def k_means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1, and each row's cosine to the nearest. Starts with rows far from each other; ties go to the first."""
    centroids = x[:1]
    for _ in range(min(k, len(x)) - 1):
        near = (x @ centroids.T).max(1)
        if near.min() > 1 - 1e-6:
            break
        centroids = np.vstack([centroids, x[near.argmin()]])
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) for j in range(len(centroids))])
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids).astype(np.float32)
    return centroids, (x @ centroids.T).max(1)


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of the labelled rows; rows whose text or language is null teach nothing."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = {r["lang"]: r["count"] for r in found}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for texts in portions(batch.column(0)):
                for text in texts:
                    df[np.unique(grams(text))] += 1
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["gram", "df"])

    idf = np.zeros(DIMENSIONS, np.float64)
    n_rows = 0
    for r in rows.select("text").mapInArrow(frequencies, "gram int, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).collect():  # DIMENSIONS + 1 rows
        if r["gram"] < 0:
            n_rows = r["df"]
        else:
            idf[r["gram"]] = r["df"]
    idf = (np.log((1 + n_rows) / (1 + idf)) + 0.1).astype(np.float32)
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, 1)), idf)

    # about SAMPLE rows of each language by a hash; the few above are cut when they meet
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(SAMPLE / n)).otherwise(share)
    order = F.xxhash64(F.col("doc_id"), F.col("text"))
    drawn = rows.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).withColumn("order", order)
    # rows that repeat are drawn together: one of them is enough, and their group may be of any size
    drawn = drawn.groupBy("lang", "order").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))

    def clusters(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by([("order", "ascending"), ("doc_id", "ascending")]).slice(0, SAMPLE)
        x = [c for c in map(counts, found["text"].to_pylist()) if c.any()]
        if not x:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "least": pa.array([], pa.list_(pa.float64()))})
        size = bucket(np.array([c.sum() for c in x]))
        centroids, near = k_means(vectors(x, idf), CENTROIDS)
        enough = {b for b in range(CLASSES) if (size == b).sum() >= EVIDENCE}
        shorter, shorter_size = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for text in found["text"].to_pylist():
            y = [c for c in pieces(text, enough) if c.any()]
            if y:
                shorter.append((vectors(y, idf) @ centroids.T).max(1))
                shorter_size.append(bucket(np.array([c.sum() for c in y])))
        least = radii(near, size, np.concatenate(shorter), np.concatenate(shorter_size))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(centroids), pa.string()), "centroid": pa.array([c.astype("<f4").tobytes() for c in centroids], pa.binary()), "least": pa.array([least] * len(centroids), pa.list_(pa.float64()))})

    found = sorted((r["lang"], bytes(r["centroid"]), r["least"]) for r in drawn.groupBy("lang").applyInArrow(clusters, "lang string, centroid binary, least array<double>").collect())  # CENTROIDS rows per language
    least = np.array([f[2] for f in found], np.float64).reshape(len(found), CLASSES)
    bare = np.isnan(least).all(1) if len(found) else np.zeros(0, bool)
    # too few texts for any evidence: the least of the other languages; without those nothing can be said
    least[bare] = least[~bare].min(0) if (~bare).any() else 0.0
    return Model([f[0] for f in found], np.stack([np.frombuffer(f[1], "<f4") for f in found]) if found else np.zeros((0, DIMENSIONS), np.float32), least, idf)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row, repeated rows too; lang_pred is UNKNOWN, score 0 and rejected true for a text that is null or has no letter.

    With keep, those columns of the documents come instead of doc_id and held_out, before lang_pred, score and rejected,
    whose names begin with the prefix.
    """
    given = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out")]
    rows = docs.select(*given, F.col(text_col).cast("string").alias("corpusloom_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(f"{prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for texts in portions(batch.column(batch.num_columns - 1)) for x in model.predict(texts)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out())))

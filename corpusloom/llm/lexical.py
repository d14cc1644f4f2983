"""Ranked lexical search over impact-ordered postings, score at a time.

A document's postings of the queries' terms are packed with those of its neighbours into blocks. In a block every
term's postings stand in falling order of their impact, weight times saturated frequency, so that postings of one
impact form a group. A query takes the groups of all its terms in falling order of what they add to a score, a
level at a time, and adds them to accumulators. ``rest`` is the sum of the next unread groups of its terms: what
a document can still gain at most. A level ends the reading once no more than ENOUGH documents can reach the
k-th best score so far (or one that k documents of earlier blocks reach): these alone get their scores completed
from the block's postings by document. Otherwise the next level is read, down to the last group if need be.

At scale: documents are read once, by narrow tasks; their texts are never shuffled. A task keeps, per query, the
score that k documents reach already, so later blocks are left sooner and emit less; what it emits is at most k
rows per query and block, and the last window keeps k per task before it shuffles. The queries are a stated set
that goes to all tasks in portions of at most QUERY_BYTES of text; more than that are further passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

#: Documents and postings of a block, and bytes of the queries' texts that tasks hold at a time.
BLOCK, POSTINGS, QUERY_BYTES = 16_384, 4_000_000, 16 << 20
#: Levels, as shares of the largest group, and the number of documents that are worth completing.
LEVELS, ENOUGH = (0.7, 0.5, 0.35, 0.25, 0.15, 0.08, 0.0), 256
#: Stands for a null id in a block.
NO_ID = -(2**63)

#: Bytes of a term as they are, A-Z lower-cased, all others spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

PACKED = "n_docs bigint, n_terms bigint, ids binary, lengths binary, widths binary, terms binary, counts binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def pack(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents: their ids, lengths in terms, and per document its terms of the vocabulary with their counts. Documents without a term aren't counted."""
    arrays = ("<i8", "<i8", "<i4", "<i4", "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = [[], [], [], [], []]
        n_docs = n_terms = 0

        def out() -> pa.RecordBatch:
            parts = [pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in zip(held, arrays, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *parts], names=["n_docs", "n_terms", "ids", "lengths", "widths", "terms", "counts"])

        for batch in batches:
            for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(found)
                counts = Counter(found)
                own = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                if not own:
                    continue
                for x, value in zip(held, (NO_ID if id_ is None else id_, len(found), len(own)), strict=False):
                    x.append(value)
                held[3].extend(t for t, _ in own)
                held[4].extend(c for _, c in own)
                if len(held[0]) >= BLOCK or len(held[3]) >= POSTINGS:
                    yield out()
                    held, n_docs, n_terms = [[], [], [], [], []], 0, 0
        if n_docs:
            yield out()

    return docs.mapInArrow(run, PACKED)


def frequencies(blocks: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms in all, and the documents of every term; one row per term comes to the driver, as many as the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                total += np.bincount(np.frombuffer(terms.as_py(), "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = np.zeros(size, np.int64)
    for r in blocks.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    return n_docs or 0, n_terms or 0, df


class Postings:
    """A block's postings by document and, by term, in falling order of impact."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, widths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.starts = ids, np.concatenate([[0], np.cumsum(widths)])
        m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        tf = counts.astype(np.int64)
        self.terms, self.impact = terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, widths)))
        order = np.lexsort((-self.impact, terms))
        self.docs, self.falling = np.repeat(np.arange(len(ids)), widths)[order], self.impact[order]
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.times = np.zeros(len(weights), np.int64)

    def complete(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of some documents."""
        self.times[terms] = times
        out = np.array([self.times[self.terms[a:b]] @ self.impact[a:b] for a, b in zip(self.starts[docs], self.starts[docs + 1], strict=True)], np.int64)
        self.times[terms] = 0
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the k best scores of at least floor and above 0, best first, ties by id; and how many postings were read."""
        lists = [(self.docs[a:b], self.falling[a:b] * c) for a, b, c in zip(self.first[terms], self.first[terms + 1], times, strict=True) if b > a]
        scores, at, read = np.zeros(len(self.ids), np.int64), [0] * len(lists), 0
        largest, able = max((int(v[0]) for _, v in lists), default=0), np.arange(0)
        for share in LEVELS:
            cut, rest = int(largest * share), 0
            for i, (docs, values) in enumerate(lists):
                end = len(values) - int(np.searchsorted(values[::-1], cut))
                scores[docs[at[i] : end]] += values[at[i] : end]  # a document stands once in a list
                read, at[i] = read + end - at[i], end
                rest += int(values[end]) if end < len(values) else 0
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            able = np.flatnonzero(scores + rest >= max(floor, kth, 1))
            if rest == 0:
                break
            if len(able) <= ENOUGH:
                scores[able] = self.complete(able, terms, times)
                break
        able = able[scores[able] >= max(floor, 1)]
        best = able[np.lexsort((self.ids[able], -scores[able]))][:k]
        return best, scores[best], read


def portions(queries: DataFrame) -> list[list[tuple[int | None, bytes]]]:
    """The queries, each portion's texts of at most QUERY_BYTES, a single query's aside."""
    size, n = F.octet_length("text") + F.lit(64), 1
    while True:
        dealt = queries.withColumn("portion", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
        sizes = dealt.groupBy("portion").agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).orderBy("portion").collect()
        if all(r.bytes <= QUERY_BYTES or r.n == 1 for r in sizes):
            break
        n *= 2
    return [[(r.item_id, bytes(r.text)) for r in dealt.where(F.col("portion") == s.portion).collect()] for s in sizes]


def search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of every query, ties to the smaller id.

    Null texts have no terms; texts of any length count whole. Rows that share an id are documents each, and
    queries each, with ranks of their own; a null id ranks before others. A query without terms, or whose terms
    stand in no document, gives no rows, nor do empty tables. Only the named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item_id"), F.col(query_col).cast("string").cast("binary").alias("text"))
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for portion in portions(asked):
        found = found.unionByName(search_portion(rows, portion, k))
    return found


def search_portion(rows: DataFrame, portion: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    wanted = [(item, Counter(terms_of(text))) for item, text in portion]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in wanted))))}
    asked = [(item, np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for item, c in wanted]
    blocks = materialise(pack(rows, vocabulary), "postings")
    n_docs, n_terms, df = frequencies(blocks, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [0] * len(asked)
        for batch in batches:
            for r in range(batch.num_rows):
                block = [np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("ids", "<i8"), ("lengths", "<i8"), ("widths", "<i4"), ("terms", "<i4"), ("counts", "<i4"))]
                if not len(block[0]):
                    continue
                postings = Postings(*block, weights, n_docs, n_terms)
                out: list[tuple[int, int | None, int | None, int]] = []
                for q, (item, terms, times) in enumerate(asked):
                    best, scores, _ = postings.search(terms, times, k, floors[q])
                    out += [(q, item, None if i == NO_ID else i, s) for i, s in zip(postings.ids[best].tolist(), scores.tolist(), strict=True)]
                    if len(best) == k:
                        floors[q] = max(floors[q], int(scores[-1]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)], names=["query", "item_id", "doc_id", "score"])

    best = blocks.drop("n_docs", "n_terms").mapInArrow(run, "query int, item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


SQL = r"""
WITH a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_, 'abcdefghijklmnopqrstuvwxyz' AS lower_, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term_),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, upper_, lower_), term_) AS t FROM documents, a WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, upper_, lower_), term_) AS t FROM benchmark, a WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
i AS (
  SELECT r, doc_id, term, CAST(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS BIGINT) AS impact
  FROM f JOIN w USING (term), s),
z AS (SELECT q, item_id, unnest(t) AS term FROM q),
y AS (SELECT q, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM z JOIN i USING (term) GROUP BY q, item_id, r, doc_id),
x AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM y WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM x WHERE rank <= 20
"""

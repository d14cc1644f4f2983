"""Exact top-k inner products by no-random-access aggregation over sorted lists.

The candidates come in blocks. In a block, dimension j has one list of the components in falling order
and the same list read backwards: a query reads it from the end that its own component favours. The
lists are read in rounds, deeper each time. After reading to depth d, a candidate's score lies between

    sum over lists of: its own entry where read, else the entry at d      (upper bound)
    sum over lists of: its own entry where read, else the last entry      (lower bound)

A candidate whose upper bound is below the query's k-th largest lower bound cannot qualify. Nothing is
read out of order: a query leaves a block once none of its candidates can qualify; otherwise the lists
are read to their ends, which are full products with all candidates of the block. A query carries its k best scores
from block to block, so that later blocks may be discarded before their lists have been read whole. All bounds of
a round are two matrix products, for all queries and candidates of the block at once.

At scale: candidates are packed into blocks of BLOCK vectors and queries into blocks of QUERIES, both
bounded. Blocks of candidates are dealt over parts, as many as blocks but no more than a few per
shuffle partition, that each hold a copy of the stated queries' blocks and meet them by an equi-join on
the part. A pair of blocks leaves k rows per query, which combine by a window with a limit per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, table

#: Vectors in a block of candidates and of queries; depths of the rounds as shares of a list; factor of the components.
BLOCK, QUERIES = 4096, 1024
DEPTHS = (0.05, 0.25, 0.6, 1.0)
SCALE = 256
#: Greatest and least score that a row can carry; what lies beyond is written as the nearer of them.
MOST, LEAST = 2**63 - 1, -(2**63)

RESULT = "query_block bigint, place int, query_id bigint, vec_id bigint, score bigint"


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and the components as integers, floor(SCALE * x), of vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("bigint")).alias("v"), F.size(vec_col).alias("width"))


def blocks(rows: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
    """Packs the rows of each task into blocks: width, ids and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, vectors = held.pop(width)
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.concatenate(vectors).astype("<i8").tobytes()], pa.binary())], names=["width", *names])

        for batch in batches:
            flat, starts = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column("width").to_numpy())])
            for i, (vec_id, width) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                ids, vectors = held.setdefault(width, ([], []))
                ids.append(vec_id)
                vectors.append(flat[starts[i] : starts[i + 1]])
                if len(ids) == size:
                    yield out(width)
        for width in list(held):
            yield out(width)

    return rows.where("vec_id is not null").mapInArrow(run, f"width int, {names[0]} binary, {names[1]} binary")


class SortedLists:
    """The lists of a block of candidates, in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.n, self.width = x.shape
        by = np.argsort(self.x, axis=0, kind="stable")  # rising
        self.sorted = np.take_along_axis(self.x, by, 0)
        self.place = np.empty_like(by)
        np.put_along_axis(self.place, by, np.arange(self.n)[:, None], 0)

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """What reading to a depth knows of each entry: the greatest and least it can be, from the top end and from the bottom end."""
        low, high = self.sorted[0], self.sorted[-1]
        at_top, at_bottom = self.sorted[self.n - depth], self.sorted[depth - 1]
        top, bottom = self.place >= self.n - depth, self.place < depth
        return np.where(top, self.x, at_top), np.where(top, self.x, low), np.where(bottom, self.x, at_bottom), np.where(bottom, self.x, high)


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    return np.partition(values, values.shape[1] - k, 1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def search(lists: SortedLists, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(query's place, candidate's place, score) of what may be among the k best; floor: scores that k others reach already, raised here."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(lists.x).max(initial=0)) * lists.width < 2.0**52
    kind = np.float64 if exact else object  # Python's integers where doubles would round
    plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    live, columns = np.arange(len(q)), np.arange(lists.n)  # queries and candidates that may still meet
    own = query_ids[:, None] == lists.ids[None, :]
    for share in DEPTHS:
        depth = max(1, min(lists.n, int(np.ceil(share * lists.n))))
        most_top, least_top, least_bottom, most_bottom = (a[columns].astype(kind) for a in lists.read(depth))
        p, m = plus[live], minus[live]
        # a negative component favours small entries: what may be least of an entry gives most of the product
        upper = (p @ most_top.T + m @ least_bottom.T).astype(np.float64)
        lower = (p @ least_top.T + m @ most_bottom.T).astype(np.float64) if depth < lists.n else upper
        no = own[np.ix_(live, columns)]
        upper[no] = lower[no] = -np.inf
        floor[live] = np.maximum(floor[live], kth(lower, k))
        if depth == lists.n:
            break
        able = upper >= floor[live, None]
        live, columns = live[able.any(1)], columns[able.any(0)]
        if not len(live):
            return
    if not exact:
        scores = p @ most_top.T + m @ least_bottom.T
    for i, row in enumerate(live.tolist()):
        found = np.flatnonzero((upper[i] >= floor[row]) & ~own[row, columns])
        if exact:  # of equal scores those of the smallest ids
            found = found[np.lexsort((lists.ids[columns[found]], -upper[i][found]))]
        else:
            found = np.array(sorted(found.tolist(), key=lambda j: (-scores[i, j], lists.ids[columns[j]])), int)
        for j in found[:k].tolist():
            yield row, int(columns[j]), min(MOST, max(LEAST, int(upper[i, j] if exact else scores[i, j])))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k candidates of the largest integer inner product, ties to the smaller id.

    A row is no candidate of the query of its own id. Vectors that are null, empty or hold a component
    that is null or not finite take no part, nor do rows without an id; vectors of different lengths
    don't meet. Rows that share an id are candidates each, and queries each, with k rows of their own.
    Fewer candidates than k give fewer rows. Components beyond the range of a long count as its ends,
    and so do scores, whose order within a block follows their exact values all the same.
    """
    spark = vectors.sparkSession
    asked = blocks(whole(queries, id_col, vec_col), QUERIES, ("q_ids", "q"))
    asked = materialise(asked.withColumn("query_block", F.monotonically_increasing_id()), "queries")
    given = blocks(whole(vectors, id_col, vec_col), BLOCK, ("ids", "x"))
    # each pair of a candidates' and a queries' block is a unit of its own; the copies of the queries are dealt over the blocks of candidates
    spread = max(1, min(-(-vectors.count() // BLOCK), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(spread)).cast("int")
    given = given.withColumn("dealt", dealt)
    asked = asked.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        last, lists = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                width, ids, x, q_ids, q, number = (batch.column(c)[r].as_py() for c in ("width", "ids", "x", "q_ids", "q", "query_block"))
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                if last != (width, x):  # a block's pairs follow each other: it is sorted once
                    last, lists = (width, x), SortedLists(ids, np.frombuffer(x, "<i8").reshape(-1, width))
                floor = floors.setdefault(number, np.full(len(q_ids), -np.inf))
                found = [(number, i, int(q_ids[i]), int(lists.ids[j]), s) for i, j, s in search(lists, q_ids, np.frombuffer(q, "<i8").reshape(-1, width), k, floor)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["query_block", "place", "query_id", "vec_id", "score"])

    pairs = given.join(asked.hint("merge"), ["width", "dealt"]).select("width", "ids", "x", "q_ids", "q", "query_block")
    best = pairs.mapInArrow(run, RESULT)
    order = Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

"""A map's layout that keeps neighbourhoods: fuzzy weights on the neighbour graph, a spectral start, sampled descent.

The method is that of McInnes, Healy and Melville, 2018. Positions are a table; a round joins the edges with it twice
and sums forces by point, so nothing grows on the driver: it sees matrices of a few components and, per round, at most
``POOL`` positions, from which the points that repel are drawn. Draws are hashes of ids, round and seed; they don't
depend on partitions. Each round is written to the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import atlas
from corpusloom.sources.generations import scratch

#: Points of which a round draws those that repel, draws per sampled edge, and the longest component of a push.
POOL, NEGATIVES, PUSH = 4096, 5, 4.0
#: Steps of the power iteration, and how many go between two orthonormalisations.
STEPS, STRIDE = 16, 4
#: Half the width of the start, and the first step of the descent.
EXTENT, RATE = 10.0, 1.0


class _Tables:
    """Tables in the shared folder that are deleted once nothing reads them."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession

    def keep(self, df: DataFrame, *gone: DataFrame) -> DataFrame:
        path = scratch(self.spark, "layout")
        df.write.option("compression", "zstd").parquet(path)
        self.drop(*gone)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fuzzy_weights(graph: DataFrame, turns: int = 64) -> DataFrame:
    """(src, dst, w) in both directions from a neighbour graph (src, dst, cosine).

    A point's own weights fall from its nearest neighbour on, at the pace at which they sum to the logarithm of their
    number to base 2; weights a and b of two directions make a + b - a b.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["near"].map(len)):
                near = np.stack([[(n["cosine"], n["dst"]) for n in row] for row in part["near"]])
                d = np.maximum(1 - near[..., 0].astype(np.float64), 0)
                d = d - d.min(1, keepdims=True)
                low, high = np.full(len(d), 1e-6), np.full(len(d), 1e3)
                for _ in range(turns):
                    mid = np.sqrt(low * high)
                    above = np.exp(-d / mid[:, None]).sum(1) > np.log2(max(d.shape[1], 2))
                    high, low = np.where(above, mid, high), np.where(above, low, mid)
                ids = [[n["dst"] for n in row] for row in part["near"]]
                yield pd.DataFrame({"src": np.repeat(part["src"].to_numpy(), d.shape[1]), "dst": np.concatenate(ids), "w": np.exp(-d / high[:, None]).ravel()})

    near = graph.groupBy("src").agg(F.collect_list(F.struct("cosine", "dst")).alias("near"))  # as many as the graph has a point
    one = near.mapInPandas(run, "src bigint, dst bigint, w double")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w"))


def spectral(edges: DataFrame, start: DataFrame, dims: int, steps: int = STEPS) -> DataFrame:
    """(id, x0, x1, ...): the first axes of the normalised graph beside the constant one, by power iteration from ``start`` (id, p).

    The axes are those that ``steps`` rounds of smoothing leave, orthonormal; what the start lacks stays out.
    """
    held, names = _Tables(edges), [f"x{i}" for i in range(dims)]
    degree = edges.groupBy("src").agg(F.sqrt(F.sum("w")).alias("s"))
    v = held.keep(start.join(degree, start["id"] == degree["src"], "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"), *(F.coalesce(F.get("p", i), F.lit(0.0)).alias(n) for i, n in enumerate(names))))
    s = v.select("id", "s")
    links = edges.join(s.toDF("src", "a"), "src").join(s.toDF("dst", "b"), "dst")
    links = held.keep(links.select("src", "dst", (F.col("w") / (F.col("a") * F.col("b"))).alias("c")))
    for at in range(0, steps + 1, STRIDE):
        m = v.agg(*(F.sum(F.col(a) * F.col(b)) for a in ["s", *names] for b in ["s", *names])).first()
        g = np.array([x or 0.0 for x in m]).reshape(dims + 1, dims + 1)
        along = g[0, 1:] / g[0, 0] if g[0, 0] > 0 else np.zeros(dims)
        values, axes = np.linalg.eigh(g[1:, 1:] - np.outer(along, along) * g[0, 0])
        scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
        turn = axes * scale  # principal directions of what is left, each of length 1
        turn = turn[:, ::-1] * np.where(turn[np.abs(turn).argmax(0), np.arange(dims)] < 0, -1, 1)[::-1]
        free = [F.col(n) - F.col("s") * float(along[i]) for i, n in enumerate(names)]
        y = v.select("id", "s", *(sum((free[i] * float(turn[i, j]) for i in range(dims)), F.lit(0.0)).alias(names[j]) for j in range(dims)))
        for _ in range(STRIDE if at < steps else 0):
            met = links.join(y.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(*(F.sum(F.col("c") * F.col(n)).alias(f"t{i}") for i, n in enumerate(names)))
            y = y.join(met, y["id"] == met["src"], "left").select("id", "s", *(((F.col(n) + F.coalesce(f"t{i}", F.lit(0.0))) / 2).alias(n) for i, n in enumerate(names)))
        v = held.keep(y, v)
    held.drop(links)
    return v.select("id", *names)


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), least squares against 1 up to min_dist and exp(-(d - min_dist) / spread) beyond, by Gauss and Newton."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        u = a * d ** (2 * b)
        f = 1 / (1 + u)
        slope = np.stack([-f * f * u / a, -f * f * u * 2 * np.log(d)], 1)
        step = np.linalg.lstsq(slope, want - f, rcond=None)[0]
        a, b = max(a + step[0] / 2, 1e-3), max(b + step[1] / 2, 1e-3)
    return float(a), float(b)


def pulls(p: np.ndarray, q: np.ndarray, others: np.ndarray, apart: np.ndarray, a: float, b: float) -> np.ndarray:
    """What moves points p: towards q, and away from others (point, draw, component) where ``apart`` holds."""
    gap = p - q
    d2 = (gap * gap).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        move = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 0) * gap
    away = p[:, None, :] - others
    e2 = (away * away).sum(2, keepdims=True)
    push = np.clip(2 * b / ((0.001 + e2) * (1 + a * e2**b)) * away, -PUSH, PUSH)
    return np.clip(move, -PUSH, PUSH) + np.where(apart[..., None], push, 0).sum(1)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number of their vec_id: itself, or where it isn't integral a hash under the first salt that parts all ids."""
    if dict(rows.dtypes)["vec_id"] in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("number", F.col("vec_id").cast("bigint"))
    salt = 0
    while not rows.groupBy(F.xxhash64("vec_id", F.lit(salt)).alias("number")).count().where("count > 1").isEmpty():
        salt += 1
    return rows.withColumn("number", F.xxhash64("vec_id", F.lit(salt)))


def neighbour_layout(vectors: DataFrame, dims: tuple[int, ...] = (2, 3), k: int = atlas.NEIGHBOURS, min_dist: float = 0.15, rounds: int = 60, seed: int = 42) -> DataFrame:
    """(vec_id, p): for each of ``dims`` a layout, one after the other in p, rounded to 4 places.

    All layouts go through the same rounds. An edge takes part in a round with a probability of its weight. A point moves by the
    mean of what its sampled edges and their draws give, so that a hub needs no smaller step. vec_id is of any type and
    names a vector: of rows that repeat it the smallest vector counts. Null and zero vectors take no part, equal ones are
    placed near each other, one alone is at the origin; other columns are left out. The same table, seed and parameters
    give the same places but for the order of floating-point sums.
    """
    held, (a, b) = _Tables(vectors), curve(min_dist)
    rows = vectors.where("vec_id is not null and exists(embedding, x -> x <> 0)").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    named = held.keep(numbered(rows))
    given = named.select(F.col("number").alias("vec_id"), "embedding")
    edges = held.keep(fuzzy_weights(atlas.knn_graph(given, k)))
    start = atlas.layout(given, max(dims)).withColumnRenamed("vec_id", "id")
    at = spectral(edges, start, max(dims))
    wide = [float(x or 1.0) or 1.0 for x in at.agg(*(F.max(F.abs(f"x{i}")) for i in range(max(dims)))).first()]
    noise = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(20001)) - 10000) / 1e7  # noqa: E731  parts points of one place
    axes = [i for n in dims for i in range(n)]
    lone = edges.isEmpty()
    pos = held.keep(at.select("id", F.array(*(F.lit(0.0) if lone else F.col(f"x{i}") * (EXTENT / wide[i]) + noise(i) for i in axes)).alias("p")), at)
    ends = np.cumsum([0, *dims])
    for r in range(0 if lone else rounds):
        pool = pos.orderBy(F.xxhash64("id", F.lit(seed), F.lit(r)), "id").limit(POOL).collect()  # POOL rows at most
        ids, places = np.array([x["id"] for x in pool]), np.array([x["p"] for x in pool])

        def run(batches: Iterator[pd.DataFrame], ids=ids, places=places) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                f = np.zeros((len(pdf), ends[-1]))
                on = pdf["q"].notna().to_numpy()
                if on.any():
                    p, q, pick = (np.stack(pdf.loc[on, c].to_numpy()) for c in ("p", "q", "picks"))
                    apart = ids[pick] != pdf.loc[on, "id"].to_numpy()[:, None]
                    f[on] = np.concatenate([pulls(p[:, i:j], q[:, i:j], places[pick][..., i:j], apart, a, b) for i, j in zip(ends, ends[1:], strict=False)], 1)
                yield pd.DataFrame({"id": pdf["id"], "p": pdf["p"], "n": on.astype("int64")} | {f"f{i}": f[:, i] for i in range(ends[-1])})

        draw = lambda *what: F.xxhash64("src", "dst", F.lit(seed), F.lit(r), *what)  # noqa: E731, B023
        # by the pair's smaller id first, so that both directions of an edge are sampled together
        chance = F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed), F.lit(r)), F.lit(1 << 30)) / (1 << 30)
        live = edges.where(chance < F.col("w")).select("src", "dst", F.array(*(F.pmod(draw(F.lit(i)), F.lit(len(pool))).cast("int") for i in range(NEGATIVES))).alias("picks"))
        met = live.join(pos.toDF("dst", "q"), "dst").drop("dst")
        moves = pos.join(met, pos["id"] == met["src"], "left").select("id", "p", "q", "picks")
        moves = moves.mapInPandas(run, ", ".join(["id bigint, p array<double>, n bigint", *(f"f{i} double" for i in range(ends[-1]))]))
        summed = moves.groupBy("id").agg(F.any_value("p").alias("p"), F.greatest(F.sum("n"), F.lit(1)).alias("n"), F.array(*(F.sum(f"f{i}") for i in range(ends[-1]))).alias("f"))
        step = RATE * (1 - r / rounds)
        pos = held.keep(summed.select("id", F.zip_with("p", "f", lambda x, y: x + y * step / F.col("n")).alias("p")), pos)  # noqa: B023
    out = held.keep(named.join(pos, named["number"] == pos["id"]).select("vec_id", F.transform("p", lambda x: F.round(x, 4)).alias("p")), pos, named)
    held.drop(edges)
    return out

"""A map of vectors: nearest neighbours, a layout, points, edges, bounds, viewport and hit test."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import once

#: Vectors of a block, blocks of a part at most, parts of a table that has fewer, and neighbours.
BLOCK, BLOCKS, SIDE, NEIGHBOURS = 2048, 32, 12, 12


def blocks_of(vectors: DataFrame) -> DataFrame:
    """One row per block: ids and their vectors of length 1; null and zero vectors take no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                ok = norm > 0
                if ok.any():
                    yield pd.DataFrame({"ids": [part["id"].to_numpy()[ok].astype("<i8").tobytes()], "x": [(x[ok] / norm[ok, None]).tobytes()], "width": [x.shape[1]]})

    return vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null").mapInPandas(run, "ids binary, x binary, width int")


def nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """(src, dst, cosine): of each vector of the left blocks its k best of the right ones.

    Products in single precision leave what may be among the k, of which the cosines are taken in double; so each block
    after the first is hardly more than its product.
    """
    out = []
    blocks = [(np.frombuffer(i, "<i8"), np.frombuffer(x).reshape(-1, w)) for i, x, w in zip(right["ids"], right["x"], right["width"], strict=True)]
    single = [x.astype(np.float32) for _, x in blocks]
    for i, x, w in zip(left["ids"], left["x"], left["width"], strict=True):
        ids, x = np.frombuffer(i, "<i8"), np.frombuffer(x).reshape(-1, w)
        slack, low, own = np.float32(w * 2.4e-7 + 2 * 10.0**-digits), np.full(len(ids), -np.inf, np.float32), x.astype(np.float32)
        row, dst, c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for (b_ids, b), b_single in zip(blocks, single, strict=True):
            s = own @ b_single.T
            if np.isin(ids, b_ids).any():
                s[ids[:, None] == b_ids[None, :]] = -np.inf
            if s.shape[1] > k and np.isneginf(low).any():
                at = s.shape[1] - k
                low = np.maximum(low, np.partition(s, at, axis=1)[:, at])
            r, at = np.nonzero((s >= (low - slack)[:, None]) & (s > -np.inf))
            row, dst = np.concatenate([row, r]), np.concatenate([dst, b_ids[at]])
            c = np.concatenate([c, *(np.round(np.einsum("ij,ij->i", x[r[n : n + BLOCK * 8]], b[at[n : n + BLOCK * 8]]), digits) for n in range(0, len(r), BLOCK * 8))])
            order = np.lexsort((dst, -c, row))
            row, dst, c = row[order], dst[order], c[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            low[row[place == k - 1]] = c[place == k - 1]
            row, dst, c = row[place < k], dst[place < k], c[place < k]
        out.append(pd.DataFrame({"src": ids[row], "dst": dst, "cosine": c}))
    return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "cosine": []})


def knn_graph(vectors: DataFrame, k: int = NEIGHBOURS, digits: int = 9) -> DataFrame:
    """(src, dst, rank, cosine): the exact k nearest others by cosine, ties at ``digits`` decimals to the smaller id.

    Blocks are dealt to parts, and each part meets each in a tile of its own, which holds the two parts at any size and
    leaves k rows per vector, of which a window keeps the best. Pairs grow with the square of the vectors, as exact
    neighbours do; what a tile holds doesn't.
    """
    n = vectors.count()
    parts = -(-n // min(BLOCK * BLOCKS, max(BLOCK, n // SIDE))) or 1
    b = blocks_of(vectors).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = b.select("ids", "x", "width", F.col("part").alias("i"), every.alias("j"))
    right = b.select("ids", "x", "width", every.alias("i"), F.col("part").alias("j"))
    meet = lambda a, b: nearest(a, b, k, digits)
    pairs = left.groupBy("i", "j", "width").cogroup(right.groupBy("i", "j", "width")).applyInPandas(meet, "src bigint, dst bigint, cosine double")
    w = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "rank", "cosine")


#: Components of a text's vector.
WIDTH = 256


def text_vectors(docs: DataFrame, key: str = "id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, embedding): TF-IDF of words hashed to ``width`` components, of length 1; texts without a word have none.

    Stands in where no sentence model is at hand. Words are counted within the task that reads the text, so what is
    shuffled is ``width`` counts a text; a component's document frequency is of all texts.
    """
    words = docs.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    shape = T.StructType([T.StructField("key", words.schema["key"].dataType), T.StructField("tf", T.ArrayType(T.LongType()))])
    # texts of one key count as one
    tf = words.mapInArrow(partial(slot_counts, width=width), shape).groupBy("key").agg(F.collect_list("tf").alias("all"))
    tf = tf.select("key", F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("tf"))
    df = tf.select(F.posexplode("tf").alias("slot", "n")).where("n > 0").groupBy("slot").agg(F.count("*").alias("df"))  # width rows
    n = docs.agg(F.count("*").alias("docs"))
    idf = df.join(F.broadcast(n)).select("slot", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "idf"))).alias("m"))
    idf = idf.select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("idf"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # the vector and its length are variables of lambdas, so that each is computed once, not for each component
    unit = lambda v: once(norm(v), lambda length: F.transform(v, lambda x: x / length))
    return tf.join(F.broadcast(idf)).select(F.col("key").alias(key), once(F.zip_with("tf", "idf", lambda a, b: a * b), unit).alias("embedding"))


def slot_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(key, tf): how many words of each row's w fall to each component. A word of the batch is hashed once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            w = piece.column("w")
            words = pc.dictionary_encode(w.flatten())
            slots = np.array([int(hashlib.md5(x.encode()).hexdigest()[:7], 16) % width for x in words.dictionary.to_pylist()], np.int64)
            rows = len(piece)
            tf = np.bincount(pc.list_parent_indices(w).to_numpy() * width + slots[words.indices.to_numpy()], minlength=rows * width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(tf))
            yield pa.RecordBatch.from_arrays([piece.column("key"), lists], ["key", "tf"])


def point_rows(rows: DataFrame, kind: str, url: Column, subtitle: str = "subtitle") -> DataFrame:
    """Points of a collection without coordinates; an empty subtitle is null."""
    return rows.select(F.concat(F.lit(f"{kind}:"), "slug").alias("id"), "slug", F.lit(kind).alias("type"), "title", F.nullif(subtitle, F.lit("")).alias("subtitle"), url.alias("url"))


def layout(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, p): coordinates on the first principal axes, rounded to 4 places; each axis' largest loading is positive.

    Second moments are summed within tasks, so that a matrix per task is what is gathered.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n, total, square = n + len(x), x.sum(0) + (0 if total is None else total), x.T @ x + (0 if square is None else square)
        if n:
            m = np.concatenate([[n], total, square.ravel()])
            yield pd.DataFrame({"i": np.arange(len(m)), "m": m})

    v = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    m = np.array([r["m"] for r in v.select("v").mapInPandas(moments, "i int, m double").groupBy("i").agg(F.sum("m").alias("m")).orderBy("i").collect()])  # width squared
    if not len(m):
        return v.select("vec_id", F.array().cast("array<double>").alias("p"))
    n, width = m[0], int((-1 + (1 + 4 * (len(m) - 1)) ** 0.5) / 2)
    mean = m[1 : 1 + width] / n
    _, axes = np.linalg.eigh(m[1 + width :].reshape(width, width) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dims]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    dot = lambda a: F.aggregate(F.zip_with("v", F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(-float(mean @ a)), lambda s, x: s + x)
    return v.select("vec_id", F.array(*(F.round(dot(axes[:, j]), 4) for j in range(axes.shape[1]))).alias("p"))


def map_tables(terms: DataFrame, sources: DataFrame, provenance: DataFrame, vectors: DataFrame, neighbourhoods: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points with coordinates and edges with their kind, as ``sources.tables.write_atlas`` takes them.

    terms, sources: slug, title, subtitle, url. provenance: term, doc. vectors: id, embedding; a point without a
    vector is left out, and so is an edge without both its points. Places are on the principal axes, or keep neighbourhoods
    (``layout.neighbour_layout``).
    """
    rows = point_rows(terms, "term", F.col("url")).unionByName(point_rows(sources, "source", F.col("url")))
    given = vectors.select(F.col("id").alias("vec_id"), "embedding")
    if neighbourhoods:
        from corpusloom.operators.layout import neighbour_layout

        places = neighbour_layout(given, (3, 2))
        rows = rows.join(places.select(F.col("vec_id").alias("id"), *(F.get("p", i).alias(n) for i, n in enumerate(("x3", "y3", "z3", "x2", "y2")))), "id")
    for dims, names in () if neighbourhoods else ((3, ("x3", "y3", "z3")), (2, ("x2", "y2"))):
        places = layout(given, dims).select(F.col("vec_id").alias("id"), *(F.get("p", i).alias(n) for i, n in enumerate(names)))
        rows = rows.join(places, "id")
    edges = provenance.select(F.concat(F.lit("term:"), "term").alias("source"), F.concat(F.lit("source:"), "doc").alias("target"), F.lit("discussed-in").alias("kind"))
    return rows, edges_between(edges, rows)


def edges_between(edges: DataFrame, points: DataFrame, key: str = "id") -> DataFrame:
    """Edges (source, target) both of whose ends are points."""
    ends = points.select(key)
    return edges.join(ends.withColumnRenamed(key, "source"), "source", "left_semi").join(ends.withColumnRenamed(key, "target"), "target", "left_semi")


def visible(points: DataFrame, kinds: list[str], query: str = "") -> DataFrame:
    q = query.strip().lower()
    text = F.lower(F.concat_ws(" ", "title", "subtitle"))
    return points.where(F.col("type").isin(kinds) & (F.lit(True) if not q else F.contains(text, F.lit(q))))


def bounds(points: DataFrame, x: str = "x2", y: str = "y2") -> DataFrame:
    return points.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.count("*").alias("n"))


def to_screen(x: Column, scale: float, offset: float) -> Column:
    return x * scale + offset


def zoom_about(scale: float, ox: float, oy: float, cx: float, cy: float, inwards: bool) -> tuple[float, float, float]:
    """Viewport after a step of the wheel: the point under the cursor stays."""
    f = 1.1 if inwards else 0.9
    return scale * f, cx - (cx - ox) * f, cy - (cy - oy) * f


def viewport(points: DataFrame, scale: float, ox: float, oy: float, labels_from: float = 1.6) -> DataFrame:
    """Screen coordinates, and whether a label is shown: of terms, once zoomed in."""
    return points.withColumns({"sx": to_screen(F.col("x2"), scale, ox), "sy": to_screen(F.col("y2"), scale, oy), "label": (F.col("type") == "term") & F.lit(scale > labels_from)})


def hit_test(screen: DataFrame, x: float, y: float, radius: float = 8.0) -> DataFrame:
    """The first point in order within the radius."""
    return screen.where((F.col("sx") - x) * (F.col("sx") - x) + (F.col("sy") - y) * (F.col("sy") - y) < radius * radius).orderBy("ord").limit(1)

"""The map's layout: its weights, start and pulls against numpy, and that neighbours stay neighbours."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import atlas, layout

VECTORS = "vec_id bigint, embedding array<double>"


def weights(x, k):
    """Fuzzy weights of unit vectors, point by point."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    w = np.zeros((len(x), len(x)))
    for i, row in enumerate(s):
        near = np.argsort(-row, kind="stable")[:k]
        d = (1 - row[near]) - (1 - row[near]).min()
        low, high = 1e-6, 1e3
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if np.exp(-d / mid).sum() > np.log2(k) else (mid, high)
        w[i, near] = np.exp(-d / high)
    return w + w.T - w * w.T


def trustworthiness(x, places, k):
    """1 when the k nearest places of each point are among its k nearest vectors, less by the ranks of those that aren't."""
    n, s, d = len(x), 1 - x @ x.T, ((places[:, None] - places[None]) ** 2).sum(2)
    np.fill_diagonal(s, -1)
    np.fill_diagonal(d, np.inf)
    rank = np.argsort(np.argsort(s, 1), 1)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, np.argsort(d, 1)[:, :k], 1) - k, 0).sum()


def vectors_of(n, width, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_weights_and_start_equal_numpy(spark):
    x = vectors_of(60, 5)
    edges = layout.fuzzy_weights(atlas.knn_graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), 6)).persist()
    got, want = np.zeros((60, 60)), weights(x, 6)
    for r in edges.collect():
        got[r.src, r.dst] = r.w
    assert np.allclose(got, want, atol=1e-6) and np.allclose(got, got.T)

    start = vectors_of(60, 2, 4)
    found = layout.spectral(edges, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(start)], "id bigint, p array<double>"), 2, steps=8)
    y = np.array([[r.x0, r.x1] for r in found.orderBy("id").collect()])
    s = np.sqrt(want.sum(1))
    graph = want / np.outer(s, s)
    z = start - np.outer(s, s @ start) / (s @ s)
    began = np.trace(np.linalg.qr(z)[0].T @ graph @ np.linalg.qr(z)[0])
    for _ in range(8):
        z = np.linalg.qr((z + graph @ z) / 2)[0]
    assert np.allclose(y.T @ y, np.eye(2), atol=1e-6) and np.abs(y.T @ s).max() < 1e-6
    assert np.allclose(np.linalg.svd(z.T @ y)[1], 1, atol=1e-5)  # both span the same plane
    assert np.trace(y.T @ graph @ y) > began + 0.5  # smoother than the start


def test_curve_and_pulls():
    a, b = layout.curve(0.1)
    assert (a, b) == pytest.approx((1.577, 0.895), abs=2e-3)  # the published values
    p, q = np.array([[0.0, 0.0], [2.0, 0.0]]), np.array([[0.0, 0.0], [0.0, 0.0]])
    others, no = np.zeros((2, 3, 2)), np.zeros((2, 3), bool)
    assert (layout.pulls(p, q, others, no, a, b)[0] == 0).all()
    f = lambda d: np.log(1 + a * d ** (2 * b))  # noqa: E731  attraction is the slope of this
    assert layout.pulls(p, q, others, no, a, b)[1] == pytest.approx([-(f(2 + 1e-6) - f(2 - 1e-6)) / 2e-6, 0], abs=1e-5)
    assert layout.pulls(p, q, others, ~no, a, b)[1, 0] > layout.pulls(p, q, others, no, a, b)[1, 0]


def test_neighbourhoods_are_kept_better_than_by_axes(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    placed = {r.vec_id: r.p for r in layout.neighbour_layout(e, rounds=40).collect()}
    assert set(placed) == {r.vec_id for r in rows}
    p = np.array([placed[r.vec_id] for r in rows])
    for dims, mine in ((2, p[:, :2]), (3, p[:, 2:])):
        plain = {r.vec_id: r.p for r in atlas.layout(e, dims).collect()}
        assert trustworthiness(x, mine, 12) > trustworthiness(x, np.array([plain[r.vec_id] for r in rows]), 12) + 0.02


def test_groups_part_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{g}:{i}", (np.eye(3, 8)[g] + rng.normal(size=8) / 20).tolist(), i) for g in range(3) for i in range(20)]
    odd = [("none", None, 1), ("zero", [0.0] * 8, 1), (None, [1.0] * 8, 1), ("0:0", [9.0] * 8, 1), ("twin", rows[0][1], 1), ("", [0.0] * 7 + [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id string, embedding array<double>, p int")
    got = {r.vec_id: np.array(r.p) for r in layout.neighbour_layout(df, (2,), k=6, rounds=15).collect()}
    assert set(got) == {r[0] for r in rows} | {"twin", ""} and all(np.isfinite(v).all() for v in got.values())
    middle = [np.mean([got[f"{g}:{i}"] for i in range(20)], 0) for g in range(3)]
    own = sum(np.argmin([np.linalg.norm(got[f"{g}:{i}"] - m) for m in middle]) == g for g in range(3) for i in range(20))
    assert own >= 57


def test_few_points(spark):
    none = spark.createDataFrame([], VECTORS)
    assert layout.neighbour_layout(none, rounds=2).collect() == []
    one = spark.createDataFrame([(7, [0.5, 1.0])], VECTORS)
    assert [tuple(r) for r in layout.neighbour_layout(one, rounds=2).collect()] == [(7, [0.0] * 5)]
    same = spark.createDataFrame([(i, [0.5, 1.0]) for i in range(3)], VECTORS)
    assert all(np.isfinite(r.p).all() for r in layout.neighbour_layout(same, rounds=2).collect())


def test_graph_in_parts(spark, monkeypatch):
    monkeypatch.setattr(atlas, "BLOCK", 8)
    monkeypatch.setattr(atlas, "BLOCKS", 2)
    x = vectors_of(100, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(5)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    for r in atlas.knn_graph(df, 3).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("n")).collect():
        assert [n.dst for n in r.n] == np.argsort(-s[r.src], kind="stable")[:3].tolist()


def test_nearest_of_a_tile_breaks_ties_across_blocks():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    x[10:50] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(90)
    blocks = pd.DataFrame({"ids": [ids[i : i + 30].astype("<i8").tobytes() for i in (0, 30, 60)], "x": [x[i : i + 30].tobytes() for i in (0, 30, 60)], "width": 4})
    got = atlas.nearest(blocks, blocks, 5, 9)
    assert len(got) == 90 * 5
    s = np.round(x @ x.T, 9)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
        assert got[got["src"] == ids[i]].sort_values(["cosine", "dst"], ascending=[False, True])["dst"].tolist() == [ids[j] for j in want]

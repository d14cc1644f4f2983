"""Ranked lexical search, rendezvous shards and the prefix trie against brute force, on odd rows and in small blocks and parts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import common, lexical, shards, trie

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    rows = [(i, split(t)) for i, t in docs]
    rows = [r for r in rows if r[1]]
    n_docs, n_terms = len(rows), sum(len(t) for _, t in rows)
    df = Counter(t for _, own in rows for t in set(own))
    out = []
    for item, text in items:
        scores = []
        for i, own in rows:
            tf, m, s = Counter(own), 75 + 25 * len(own) * n_docs // n_terms, 0
            for t in split(text):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) if tf[t] else 0
            if s > 0:
                scores.append((-s, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "It's", "A1", "ß"]
    p = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, rng.integers(1, 40), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize(("block", "enough", "portion"), [(16_384, 256, 16 << 20), (7, 0, 200), (50, 3, 1000)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, block, enough, portion):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ENOUGH", enough)
    monkeypatch.setattr(lexical, "QUERY_BYTES", portion)
    rng = np.random.default_rng(block)
    texts = corpus(rng, 150)
    docs = list(enumerate(texts)) + [(200, None), (201, ""), (202, " -- "), (None, texts[3]), (5, texts[5]), (5, texts[5]), (300, texts[7]), (301, texts[7]), (302, " ".join(texts) * 20), (303, "x" * 50_000), (304, "WORD w1" + "é" * 9)]
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))] + [(50, None), (51, ""), (52, "unseen Terms"), (53, texts[7]), (53, texts[7]), (None, texts[9]), (54, "w0 w0 w0 W0 x"), (55, "x" * 50_000)]
    given = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in docs], "doc_id bigint, text string, rank int, score int, query string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted([tuple(r) for r in lexical.search(given, asked, 20).collect()], key=str)
    assert got == ranked(docs, items, 20)
    assert lexical.search(given.where("doc_id < 0"), asked, 20).count() == 0 == lexical.search(given, asked.where("item_id < 0"), 20).count()


def test_lexical_search_stops_early():
    """Of a block where few documents hold the rare term, the postings of the common one are left unread."""
    rng = np.random.default_rng(4)
    n = 5000
    lengths = rng.integers(80, 120, n)
    widths = np.where(np.arange(n) < 30, 2, 1)
    terms = np.concatenate([[0, 1] if w == 2 else [0] for w in widths]).astype(np.int32)
    counts = rng.integers(1, 9, len(terms)).astype(np.int32)
    p = lexical.Postings(np.arange(n), lengths, widths, terms, counts, np.array([3, 6000]), n, int(lengths.sum()))
    best, scores, read = p.search(np.array([0, 1]), np.array([1, 1]), 20, 0)
    whole = p.complete(np.arange(n), np.array([0, 1]), np.array([1, 1]))
    order = np.lexsort((np.arange(n), -whole))[:20]
    assert best.tolist() == order.tolist() and scores.tolist() == whole[order].tolist() and read < 100
    assert len(p.search(np.array([0]), np.array([1]), 20, int(whole.max()) + 1)[0]) == 0


def draw(key, shard):
    return -math.log((int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)


def test_shards_equal_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "PART_ROWS", 40)
    texts = [None, "", "é😀", "x" * 100_000, "same", "same"]
    rows = [(i, texts[i % 6]) for i in range(400)] + [(None, "n"), (None, None), *[(7, "hot")] * 150, *[(7, "other")] * 3]
    df = spark.createDataFrame([(i, t, 9, 9, "s") for i, t in rows], "doc_id bigint, text string, shard int, slot int, corpusloom_bid string").repartition(3)
    weights = [1.0, 2.0, 0.5, 4.0]
    got = shards.shard_documents(df, weights, 3.0).collect()
    plain = lambda i: (i.doc_id, i.size, i.text_crc32)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(map(plain, got)) == want and {r.law for r in got} == {"key"}
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        bids = [draw(key, s) / w for s, w in enumerate([*weights, 3.0])]
        assert r.shard == int(np.argmin(bids[:4])) and r.grown_shard == int(np.argmin(bids))
        assert r.grown_shard in (r.shard, 4)
    for s in range(4):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in own]
        assert order == sorted(order)
    assert shards.shard_documents(df.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(df, [1.0, 0.0])
    folder = shards.write_shards(df, weights, folder=f"{tmp_path}/shards")
    written = spark.read.parquet(folder)
    assert Counter((r.doc_id, r.text, r.shard) for r in written.collect()) == Counter((i, t, {r.doc_id: r.shard for r in got}[i]) for i, t in rows)


def test_shards_hold_their_share_and_move_few(spark):
    df = shards.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), [1.0, 2.0, 1.0, 4.0], 2.0)
    held, moved = Counter(), 0
    for r in df.collect():
        held[r.shard] += 1
        moved += r.shard != r.grown_shard
        assert r.grown_shard in (r.shard, 4)
    for s, w in enumerate([1, 2, 1, 4]):
        assert abs(held[s] / 20_000 - w / 8) < 0.012
    assert abs(moved / 20_000 - 0.2) < 0.012


def nodes_of(rows):
    """The contract's nodes, by brute force over all prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:]
    nodes = {}
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), sum(leaf(p) for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("part", "run", "chunk"), [(4_000_000, 4096, 1 << 16), (20, 3, 5)])
def test_trie_equals_brute_force(spark, monkeypatch, part, run, chunk):
    monkeypatch.setattr(common, "PART_ROWS", part)
    monkeypatch.setattr(trie, "RUN", run)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rng = np.random.default_rng(part)
    rows = [(c, t, "user" if t % 2 == 0 else "bot", rng.choice(["a", "bb", "😀é"])) for c in [*range(100, 118), 3, 207, -104] for t in range(rng.integers(1, 8))]
    long = [(c, t, "user", f"turn {t % 5}") for c in (300, 301, 302, 412, 512) for t in range(9)]
    rows += long + [(600, 0, "user", "a"), (601, 0, "user", "a"), (None, 0, "user", "lost"), (700, None, None, None), (700, None, "user", ""), (700, 1, "", "x"), (700, 1, "", "x"), (700, 1, "a", "x"), (108, 99, None, None)]
    rows += [(c, t, "user", f"turn {t % 5}") for c in (812, 912) for t in range(8)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, label string").repartition(3)
    got = trie.prefix_trie(*trie.rebuilt(trie.turns_of(df))).collect()
    assert sorted(map(tuple, got), key=str) == nodes_of(rows)
    assert trie.prefix_trie(*trie.rebuilt(trie.turns_of(df.where("conv_id = -1")))).count() == 0
    same = spark.createDataFrame([(c, 0, "user", "same") for c in range(1, 40)], "conv_id bigint, turn int, role string, text string")
    assert sorted(map(tuple, trie.prefix_trie(*trie.rebuilt(trie.turns_of(same))).collect()), key=str) == nodes_of([tuple(r) for r in same.collect()])

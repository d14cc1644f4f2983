"""The stored index against the plain search, its near spellings against a scan, and how little it reads."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search, textindex


def corpus(spark, n, rng):
    words = ["the", "tion", "that", "thing", "straße", "naïve", "wording", "wordings", "world", "word", "swordfish", "internationalisation", "internationalization", "a", "ab", "日本", "😀é"]
    rows = [(f"source:{i:04}", "source", f"{i}", " ".join(rng.choices(words, k=3)), "", rng.choice(["one", "two words"]), f"/{i}", " ".join(rng.choices(words, k=rng.randint(0, 30))) + (" rarest" if i % 197 == 3 else "")) for i in range(n)]
    return spark.createDataFrame(rows, "id string, kind string, slug string, title string, subtitle string, collection string, url string, text string")


def test_counted(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "", "b"],), ([],), (["x"],)], "t array<string>").select(search.counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in rows] == [[("", 1), ("a", 1), ("b", 3)], [], [("x", 1)]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs = corpus(spark, 400, random.Random(2)).repartition(3)
    return docs.persist(), textindex.TextIndex.build(docs, f"file://{tmp_path_factory.mktemp('index')}/i", size=16)


@pytest.mark.parametrize(("query", "prefix", "fuzzy"), [("the tion", False, False), ("word", True, False), ("wordin the", True, True), ("internationalisatoin", True, True), ("rarest the", False, False), ("one", False, False), ("none such", True, True), (" ,", True, True), ("the the", True, True)])
def test_search_equals_the_plain_one(made, query, prefix, fuzzy):
    docs, index = made
    want = [(r.rank, r.id, round(r.score, 9)) for r in search.search(docs, query, 10, prefix, fuzzy).orderBy("rank").collect()]
    found = index.search(query, 10, prefix, fuzzy)
    assert [(r.rank, r.id, round(r.score, 9)) for r in found.rows.orderBy("rank").collect()] == want
    assert found.read["blocks"] <= found.read["of_blocks"] and found.read["entries"] <= found.read["of_entries"]


def test_a_rare_token_leaves_most_blocks_unread(made):
    read = made[1].search("rarest the", 10, False, False).read
    assert 0 < read["entries"] * 5 <= read["of_entries"] and read["blocks"] * 5 <= read["of_blocks"]
    hits = made[1].hits("rarest the", 3, False, False).collect()
    assert sorted(r.rank for r in hits) == [1, 2, 3] and all(r.snippet and r.badge in ("one", "two words") for r in hits)


def test_equal_documents_come_by_their_ids(spark, tmp_path, monkeypatch):
    """However the parts of a score are summed: each time the same score differs in its last bits."""
    words = ["the", "tion", "thing", "then", "them", "theta", "tions", "tiona"]
    rows = [(f"source:{i:03}", "source", f"{i}", "the tion", "", "one", f"/{i}", " ".join(words)) for i in range(60)] + [(f"source:x{i:03}", "source", f"x{i}", "none", "", "one", f"/x{i}", "none such") for i in range(80)]
    docs = spark.createDataFrame(rows, "id string, kind string, slug string, title string, subtitle string, collection string, url string, text string")
    index, plain = textindex.TextIndex.build(docs, f"file://{tmp_path}/i", size=16), textindex.TextIndex.scores
    noisy = lambda *given: plain(*given).withColumn("score", F.col("score") * (1 + (F.rand() - 0.5) * 1e-14))
    monkeypatch.setattr(textindex.TextIndex, "scores", staticmethod(noisy))
    want = [f"source:{i:03}" for i in range(40)]
    assert [r.id for r in index.search("the tion").rows.orderBy("rank").collect()] == want
    scores = search.scores
    monkeypatch.setattr(search, "scores", lambda *given: scores(*given).withColumn("score", F.col("score") * (1 + (F.rand() - 0.5) * 1e-14)))
    assert [r.id for r in search.search(docs, "the tion").orderBy("rank").collect()] == want


def test_near_spellings_miss_none_and_compare_few(spark, tmp_path):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdé", k=rng.randint(1, 34))) for _ in range(150)]
    words = set(base)
    for w in base:
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(1, 6)):
                at = rng.randint(0, len(x))
                rng.choice([lambda: x.insert(at, rng.choice("abcdé")), lambda: x and x.pop(min(at, len(x) - 1))])()
            words.add("".join(x) or "a")
    spark.createDataFrame([(w,) for w in words], "token string").write.parquet(f"{tmp_path}/vocabulary")
    index = textindex.TextIndex(spark, f"file://{tmp_path}")
    index.table("vocabulary").select("token", F.explode(textindex.segment_keys(F.col("token"))).alias("key")).write.parquet(f"{tmp_path}/segments")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    asked = [w for w in sorted(words) if len(w) > 2][:: max(1, len(words) // 10)]
    compared = 0
    for w in asked:
        near = {r.token for r in index.near(w).collect()}
        compared += len(near)
        assert {v for v in words if abs(len(v) - len(w)) <= 6 and distance(v, w) <= textindex.edits_for(len(w))} <= near
    assert index.near("ab").count() == 0
    assert compared < len(asked) * len(words) / 3


def test_map_file_round_trip(spark, tmp_path):
    import json

    from corpusloom.operators import atlas
    from corpusloom.sources import tables

    def rows(*v):
        return spark.createDataFrame(list(v), "slug string, title string, subtitle string, url string")

    terms, docs = rows(("t", 'A "term"', "", "/t"), ("u", "Other", "sub", "/u")), rows(("d", "Doc", None, "/d"), ("e", "É\n", "x", "/e"), ("f", "no vector", "", "/f"))
    links = spark.createDataFrame([("t", "d"), ("u", "e"), ("u", "f"), ("gone", "d")], "term string, doc string")
    vectors = spark.createDataFrame([("term:t", [1.0, 0.0, 0.0, 2.0]), ("term:u", [0.0, 1.0, 0.5, 0.0]), ("source:d", [0.5, 0.5, 0.0, 1.0]), ("source:e", [0.0, 0.0, 3.0, 1.0])], "id string, embedding array<double>")
    points, edges = atlas.map_tables(terms, docs, links, vectors)
    path = f"{tmp_path}/atlas.json"
    tables.write_atlas(points, edges, path)
    got_points, got_edges = tables.read_atlas(spark, path)
    assert sorted(map(str, got_points.collect())) == sorted(map(str, points.select(got_points.columns).collect())) and got_points.count() == 4
    assert all(None not in (r.x2, r.y2, r.x3, r.y3, r.z3) for r in got_points.collect())
    assert sorted(map(tuple, got_edges.collect())) == [("term:t", "source:d", "discussed-in"), ("term:u", "source:e", "discussed-in")]
    assert tuple(tables.read_atlas_stats(spark, path).first()) == (2, 2, 2)
    text = open(path, encoding="utf-8").read()
    assert set(json.loads(text)["points"][0]) == {"id", "type", "title", "subtitle", "x3", "y3", "z3", "x2", "y2", "url"} and ": " not in text.replace('": ', "")
    tables.write_atlas(points.where("false"), edges.where("false"), path)
    assert json.loads(open(path).read()) == {"points": [], "edges": [], "stats": {"terms": 0, "sources": 0, "edges": 0}}


def test_a_search_keeps_a_row_a_document(spark):
    """What a query asks of a document is met within its row: counts and lengths of each field, weights of what the query stands for."""
    docs = corpus(spark, 50, random.Random(5))
    rows = search.met(docs, ["word", "tionx"]).collect()
    texts = {r.id: r for r in docs.collect()}
    assert len(rows) == 50 and {r.doc for r in rows} == set(texts)
    for r in rows:
        words = {f: getattr(texts[r.doc], f).split() for f in search.FIELDS}
        assert r.lengths == [len(set(w)) for w in words.values()]
        near = {(0, "word"): 1.0, (0, "words"): 0.375 * 5 / 5.3, (0, "wording"): 0.375 * 7 / 7.9, (0, "wordings"): 0.375 * 8 / 9.2, (0, "world"): 0.45 * 5 / 6, (1, "tion"): 0.45 * 4 / 5}
        want = {(q, f, t, w.count(t), len(set(w)), round(v, 9)) for f, w in words.items() for (q, t), v in near.items() if t in w}
        assert {(h.q, h.field, h.token, h.tf, h.length, round(h.weight, 9)) for h in r.hits} == want and len(r.hits) == len(want)


def test_hits_make_only_their_own_texts_again(spark):
    """The k documents are chosen before what they are made of: of 50 texts, 3 may be read again."""
    rows = corpus(spark, 50, random.Random(6))
    docs = search.search_docs(rows.where("false"), rows)
    plan = search.search(docs, "the", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex(" IN (") > plan.rindex("regexp_replace(")


def test_the_build_shuffles_no_postings(made):
    """A range's blocks come from one task: each (token, field, range) once, entries of a range's documents only."""
    blocks = made[1].table("blocks")
    assert blocks.count() == blocks.select("token", "field", "range").distinct().count()
    e = blocks.select("range", F.explode("entries.doc").alias("doc")).distinct()
    assert e.groupBy("doc").agg(F.count_distinct("range").alias("n")).where("n > 1").count() == 0
    assert e.groupBy("range").agg(F.count_distinct("doc").alias("n")).agg(F.max("n")).first()[0] <= 16

"""The corpus build: precedence of feeds, atomic generations, and updates that equal a build from nothing."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, xref
from corpusloom.sources.generations import Generations

TERM = "slug string, title string, text string, related_names array<string>, ord string"
DOC = "slug string, title string, text string, collection string, ord string"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "lambda"]


def collections(spark, terms, docs):
    return spark.createDataFrame([(s, *v, f"0000/{s}.md") for s, v in terms.items()], TERM), spark.createDataFrame([(s, *v, f"0001/{s}.md") for s, v in docs.items()], DOC)


def state(generation):
    return sorted(map(tuple, corpus.edges(generation).collect()), key=str), sorted((r.slug, r.text, r.title) for n in ("terms", "sources") for r in generation.table(n).collect())


def test_combine(spark):
    a = spark.createDataFrame([("x", 1, "a1"), ("x", 2, "a2"), ("y", 1, "ay")], "slug string, n int, v string")
    b = spark.createDataFrame([("x", 1, "b1"), ("z", 1, "bz")], "slug string, n int, v string")
    c = spark.createDataFrame([("y", 1, "cy"), ("z", 1, "cz"), ("w", 1, "cw")], "slug string, n int, v string")
    feeds = [corpus.placed(f, i, F.col("n")) for i, f in enumerate((a, b, c))]
    got = lambda y: {r.slug: r.v for r in corpus.combine(feeds, y).collect()}
    assert got([False, True, True]) == {"x": "a2", "y": "ay", "z": "bz", "w": "cw"}
    assert got([False, False, True]) == {"x": "b1", "y": "ay", "z": "bz", "w": "cw"}
    assert got([False, True, False]) == {"x": "a2", "y": "cy", "z": "cz", "w": "cw"}
    assert corpus.placed(b.select(F.concat("slug", F.lit(".md")).alias("f")), 3, F.col("f")).orderBy("ord").first().ord == "0003/x.md"


def test_updates_equal_a_build_from_nothing(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices([*WORDS, "filler", "more"], k=6))
    term = lambda: (" ".join(rng.sample(WORDS, rng.choice([1, 1, 2]))), text(), rng.sample([*WORDS, "none"], 2))
    doc = lambda: (text(), text(), rng.choice(["one", "two", "two", None]))
    terms = {f"t{i:02}": term() for i in range(9)}
    docs = {f"d{i:02}": doc() for i in range(24)}
    store = Generations(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    corpus.build(store, *collections(spark, terms, docs))
    for step in range(2):
        for _ in range(2):
            docs.pop(rng.choice(list(docs)))
            docs[rng.choice(list(docs))] = doc()
            docs[f"d{rng.randint(0, 99):02}"] = doc()
        if step != 1:
            terms.pop(rng.choice(list(terms)))
            terms[rng.choice(list(terms))] = term()
            terms[f"t{rng.randint(0, 99):02}"] = term()
        got = corpus.build(store, *collections(spark, terms, docs))
        assert got.counts["changed_sources"] <= 6 and got.counts["changed_terms"] <= (0 if step == 1 else 3)
    plain = corpus.build(Generations(spark, f"file://{tmp_path}/plain"), *collections(spark, terms, docs))
    assert state(got) == state(plain) and plain.counts["changed_sources"] == len(docs)
    assert {e[0] for e in state(got)[0]} == {"provenance", "related_term", "related_doc"}
    assert store.numbers() == [1, 2, 3]
    whole = state(store.current())
    assert store.vacuum(keep=1) > 0 and store.numbers() == [3] and state(store.current()) == whole
    t, s = corpus.records(store.current())
    for r in t.collect():
        assert r.related == [e[2] for e in sorted((e for e in whole[0] if e[:2] == ("related_term", r.slug)), key=lambda e: e[3])] and r.provenance == sorted(e[2] for e in whole[0] if e[:2] == ("provenance", r.slug))
    assert {r.slug for r in s.collect()} == set(docs) and all(len(r.related) <= 5 for r in s.collect())


def test_a_reader_keeps_its_generation_and_one_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    from corpusloom.sources import generations

    monkeypatch.setattr(generations, "MOST_LAYERS", 2)
    store = Generations(spark, f"file://{tmp_path}/store")
    rows = lambda *v: spark.createDataFrame(list(v), "slug string, v int")
    draft = store.draft()
    store.write(draft, "t", rows(("a", 1), ("b", 1)), {"slug": rows(("a", 1), ("b", 1)).select("slug")})
    store.publish(draft)
    reader = store.current()
    one, two = store.draft(), store.draft()
    store.write(one, "t", rows(("a", 2)), {"slug": rows(("a", 0), ("b", 0)).select("slug")})
    assert sorted(map(tuple, store.current().table("t").collect())) == [("a", 1), ("b", 1)]  # not published yet
    store.publish(one)
    store.write(two, "t", rows(("c", 3)), {"slug": rows(("c", 0)).select("slug")})
    with pytest.raises(FileExistsError):
        store.publish(two)
    assert sorted(map(tuple, reader.table("t").collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, store.current().table("t").collect())) == [("a", 2)]
    third = store.draft()
    store.write(third, "t", rows(("d", 4)), {"slug": rows(("d", 0)).select("slug")})
    store.publish(third)
    assert len(store.current().tables["t"]) == 1 and sorted(map(tuple, store.current().table("t").collect())) == [("a", 2), ("d", 4)]


def test_ingest_of_all_feeds(spark, tmp_path, capsys):
    import json

    from corpusloom.__main__ import main

    def put(name, text):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    put("lexicon.md", "## I. Play\n### Slow Reading · a gloss\nOpposed to quick skimming.\n*See also:* Margin Note\n### Margin Note\nA note.\n")
    put("extra/margin-note.md", '---\ntitle: "Margin Note"\n---\n<p>loses</p>')
    put("extra/quick-skimming.md", '---\ntitle: "Quick Skimming"\n---\n<p>Not slow reading.</p>')
    put("book.txt", "Chapter 1: Begin\n" + "On slow reading and more. " * 30)
    put("posts/one.md", '---\ntitle: "One"\ndate: "2020-01-02"\n---\n# One\n\nAbout margin note and slow reading.')
    put("draft.md", "# My Draft\n\nquick skimming here")
    put("archive/blog-one.md", '---\ntitle: "Old one"\n---\nloses')
    put("archive/blog-two.md", '---\ntitle: "Two"\n---\nNothing.')
    put("manifesto.md", '---\ntitle: "Manifesto"\n---\nslow reading')
    base = f"{tmp_path}/in"
    feeds = [
        {"parser": "lexicon", "path": f"{base}/lexicon.md"}, {"parser": "terms", "path": f"{base}/extra", "yields": True}, {"parser": "book", "path": f"{base}/book.txt", "collection": "Book", "date": "2012"},
        {"parser": "posts", "path": f"{base}/posts", "collection": "Blog"}, {"parser": "draft", "path": f"{base}/draft.md", "collection": "Blog"}, {"parser": "posts", "path": f"{base}/archive", "collection": "Blog", "own_slug": True, "yields": True},
        {"parser": "posts", "path": f"{base}/missing", "collection": "Series"}, {"parser": "posts", "path": f"{base}/manifesto.md", "collection": "Canon", "kind": "manifesto", "date": "2026"},
    ]
    (tmp_path / "feeds.json").write_text(json.dumps(feeds))
    args = ["ingest", "--feeds", f"{tmp_path}/feeds.json", "--store", f"file://{tmp_path}/store", "--author", "Someone"]
    assert main([*args, "--dry-run"], spark) == 0 and "3 terms, 5 sources" in capsys.readouterr().out
    assert not (tmp_path / "store").exists()
    assert main([*args, "--export", f"{tmp_path}/out"], spark) == 0
    t, s = (x.collect() for x in corpus.records(Generations(spark, f"file://{tmp_path}/store").current()))
    assert {r.slug: (r.related, r.provenance) for r in t} == {
        "slow-reading": (["margin-note", "quick-skimming"], ["book-chapter-1-begin", "blog-one", "canon-manifesto"]),
        "margin-note": (["slow-reading"], ["blog-one"]), "quick-skimming": (["slow-reading"], ["blog-my-draft"]),
    }
    assert {r.slug: (r.title, r.kind, r.date) for r in s} == {"book-chapter-1-begin": ("Chapter 1: Begin", "book-section", "2012"), "blog-one": ("One", "post", "2020-01-02"), "blog-my-draft": ("My Draft", "draft", None), "blog-two": ("Two", "post", None), "canon-manifesto": ("Manifesto", "manifesto", "2026")}
    assert next(r.related for r in s if r.slug == "blog-two") == ["blog-one", "blog-my-draft"] and next(r.related for r in s if r.slug == "canon-manifesto") == ["book-chapter-1-begin", "blog-one"]
    assert sorted(p.name for p in (tmp_path / "out" / "sources").glob("*.md")) == ["blog-my-draft.md", "blog-one.md", "blog-two.md", "book-chapter-1-begin.md", "canon-manifesto.md"]
    assert 'related:\n  - "margin-note"' in (tmp_path / "out" / "terms" / "slow-reading.md").read_text()


@pytest.mark.parametrize("few", [0, 2, 8])
def test_related_docs_equal_all_pairs(spark, monkeypatch, few):
    """Sets of any size, met by subsets, on their terms or both, with collections that have no name."""
    monkeypatch.setattr(xref, "FEW", few)
    rng = random.Random(8)
    docs = {f"d{i:03}": (rng.choice(["one", "two", None]), set(rng.choices(range(7), weights=[9, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 6)))) for i in range(120)}
    d = spark.createDataFrame([(k, c, k) for k, (c, _) in docs.items()], "slug string, collection string, ord string")
    m = spark.createDataFrame([(f"t{t}", k) for k, (_, s) in docs.items() for t in s], "term string, doc string")
    want = {}
    for a, (c, s) in docs.items():
        same = lambda x, c=c: None if c is None or x is None else int(c == x)
        near = [(-len(s & t), {1: 0, 0: 1, None: 2}[same(x)], b, same(x)) for b, (x, t) in docs.items() if b != a and (s & t or same(x))]
        want[a] = [(b, -n, y) for n, _, b, y in sorted(near, key=lambda r: r[:3])[:5]]
    got = {}
    for r in xref.related_docs(d, m).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, r.shared, r.same))
    assert got == {k: v for k, v in want.items() if v}


def test_common_terms_give_no_pairs_of_sets(spark):
    """2,000 sets that share a term: what their subsets give grows with the sets."""
    sets = spark.range(2000).select(F.concat(F.lit("o"), "id").alias("own"), F.array(F.lit("t"), F.concat(F.lit("u"), "id")).alias("terms"))
    heads = sets.select(F.col("own").alias("other"), F.col("own").alias("dst"), F.lit("c").alias("c_dst"), F.col("own").alias("o_dst"))
    found = xref.by_subsets(sets.select("own", F.lit("c").alias("c_src")), sets, heads, 6)
    assert 2000 * 6 <= found.count() <= 2000 * 8

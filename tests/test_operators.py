import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions.html import to_markdown
from corpusloom.operators import atlas, feeds, search, split, xref
from corpusloom.sources import http, markdown, tables
from corpusloom.streaming import ingest


def test_mention_join_equals_the_nested_loop(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "  --", "c++", "é", "don't", "x_1", "(q)", "Alpha", "naïve", "--", "日本"]
    titles = [(f"t{i}", " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(40)]
    texts = [(f"d{i}", rng.choice(["", ".", "é"]).join(rng.choices([*words, " ", " ", ","], k=30))) for i in range(60)]
    t, d = spark.createDataFrame(titles, "slug string, title string"), spark.createDataFrame(texts, "slug string, text string")
    from corpusloom.functions import text as T

    slow = d.crossJoin(t.where("length(title) >= 4").select(F.col("slug").alias("term"), T.mention_regex(F.col("title")).alias("p"))).where(F.expr("text rlike p")).select("term", F.col("slug").alias("doc"))
    fast = xref.mention_join(t, d)
    assert sorted(fast.collect()) == sorted(slow.collect()) and fast.count() > 5


def test_related_terms_caps_and_backlinks(spark):
    rows = [(f"t{i:02}", f"Title{i:02}", " ".join(f"Title{j:02}" for j in range(20)) if i == 0 else "", i) for i in range(20)]
    t = spark.createDataFrame(rows, "slug string, title string, text string, ord bigint")
    got = {}
    for r in xref.related_terms(t).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got["t00"] == [f"t{i:02}" for i in range(1, 13)] and got["t05"] == ["t00"] and "t15" not in got


def test_feeds(spark):
    a = spark.createDataFrame([("a", 1), ("b", 1)], "slug string, ord bigint")
    b = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], "slug string, ord bigint")
    assert sorted(map(tuple, feeds.first_wins(a, b).collect())) == [("a", 1), ("b", 1), ("c", 2), ("c", 3)]
    assert sorted(map(tuple, feeds.last_write(b).collect())) == [("b", 2), ("c", 3)]
    assert sorted(map(tuple, tables.upsert(a, b.where("ord = 2")).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    feeds.register_parser("mine", lambda spark, n: spark.range(n))
    assert feeds.load_feed(spark, "mine", n=3).count() == 3 and feeds.split_list(" a, ,b") == ["a", "b"]


def test_lexicon(spark):
    text = '# Intro\n## II. Work & play\n### "One" · first · more\nBody *x*.\n\n---\n*Origin.* old\n*See also:* Two, "Three"; four.\n### Two\nSecond.\n## Rest\n### ···'
    rows = split.lexicon(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("ord").collect()
    assert [(r.slug, r.letter, r.title, r.subtitle, r.theme, r.origin, r.tags) for r in rows] == [("one", "O", "One", "first · more", "Work & play", "old", ["dialect", "work"]), ("two", "T", "Two", "", "Work & play", "", ["dialect", "work"])]
    assert rows[0].related_names == ["Two", '"Three', "four"] and rows[0].body_html == "<p>Body <em>x</em>.</p>"


def test_book(spark):
    long = "prose " * 100
    text = f"skip\nPart I: Start .......... 3\nPart I: Start\n{long}\n[PAGE 4]\nxii\n\nChapter 1: Go\n{long}\nChapter 2: Short\nx"
    rows = split.book(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("order").collect()
    assert [(r.order, r.title, r.subtitle) for r in rows] == [(1, "Part I: Start", ""), (2, "Chapter 1: Go", "Part I: Start")] and "PAGE" not in rows[0].body and "xii" not in rows[0].body


@pytest.mark.parametrize(("html", "md"), [
    ("<h2>T</h2><p>a <b>b</b> <i> c</i>d<br>e</p>", "## T\n\na **b**  *c*d\ne\n"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x</ol>", "- a\n  - b\n- c\n\n1. x\n"),
    ("<blockquote><p>q</p><p>r</p></blockquote><hr><pre><code>x\n y</code></pre>", "> q\n>\n> r\n\n---\n\n```\nx\n y\n```\n"),
    ("<p><b>open<br><p>two<script>x</script><div class='paywall'>no</div>", "**open**\n\ntwo\n"),
    ('<p><a href="u?a=1&amp;b">t </a>x</p><figure><img src="i"><figcaption>cap</figcaption></figure>', "[t](u?a=1&b) x\n\n*cap*\n"),
    ("", "\n"), ("</p></div><", "<\n"),
])
def test_html(html, md):
    assert to_markdown(html) == md


def test_search_ranks_and_expands(spark):
    docs = spark.createDataFrame([("a", "term", "a", "apple pie", "", "d", "/a", "sweet"), ("b", "source", "b", "pie", "", "c", "/b", "apple apples"), ("c", "source", "c", "other", "", "c", "/c", "nothing")], "id string, kind string, slug string, title string, subtitle string, collection string, url string, text string")
    assert [r.id for r in search.search(docs, "apple").orderBy("rank").collect()] == ["a", "b"]
    assert [r.id for r in search.search(docs, "aple pie").orderBy("rank").collect()] == ["a", "b"]
    assert search.search(docs, "apple nothing").count() == 0 and search.search(docs, " ").count() == 0


def test_knn_and_layout(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got = {}
    for r in atlas.knn_graph(df, 5).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    for i in set(range(60)) - {7}:
        s = np.round(u @ u[i], 9)
        assert got[i] == sorted((j for j in range(60) if j not in (i, 7)), key=lambda j: (-s[j], j))[:5]
    p = np.array([r.p for r in atlas.layout(df.where("vec_id < 60"), 2).orderBy("vec_id").collect()])
    assert abs(np.corrcoef(p.T)[0, 1]) < 1e-3 and p[:, 0].var() >= p[:, 1].var()
    assert atlas.zoom_about(1, 0, 0, 10, 10, True) == pytest.approx((1.1, -1, -1))


def test_folder_round_trip(spark, tmp_path):
    for name, text in (("a-b.md", "---\ntitle: \"T\"\ntags: [x]\n---\n# T\n\nHello there\n"), ("a.md", "plain"), ("_skip.md", "no"), ("n.txt", "no")):
        (tmp_path / name).write_text(text)
    rows = markdown.read_folder(spark, str(tmp_path))
    assert [(r.slug, r.ord) for r in rows.orderBy("ord").collect()] == [("a-b", 1), ("a", 2)]
    posts = schema.enforce_schema(markdown.parse_posts(rows, "blog", "post", "2020"), schema.SOURCES)
    first = posts.orderBy("ord").first()
    assert (first.title, first.body_md, first.tags, first.word_count, first.date) == ("T", "Hello there", ["blog", "x"], 2, "2020")
    out = markdown.write_files(markdown.render_sources(posts), f"file://{tmp_path}/out")
    assert out.count() == 2
    again = markdown.parse_posts(markdown.read_folder(spark, f"{tmp_path}/out"), "blog", "post").orderBy("ord").first()
    assert again.tags == ["blog", "x"] and again.body_md == "Hello there"
    assert markdown.read_folder(spark, str(tmp_path / "none"), optional=True).count() == 0
    assert markdown.write_files(markdown.render_sources(posts), f"file://{tmp_path}/dry", dry_run=True).count() == 2 and not (tmp_path / "dry").exists()


def test_slug_list_and_ledger(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("slug\tdate\r\n# c\r\n\r\nx\t2020\t5\tpost\tT\r\n")
    assert [tuple(r) for r in tables.read_slugs(spark, str(tmp_path / "s.tsv")).collect()] == [("x", "2020", "5", "post", "T")]
    failures = spark.createDataFrame([("a", "x \n y" + "z" * 400)], "slug string, reason string")
    row = tables.ledger_rows(failures, F.lit("2020-01-01 00:00:00").cast("timestamp")).first()
    assert row.at == "2020-01-01T00:00:00Z" and row.reason.startswith("x yz") and len(row.reason) == 300


def test_retries():
    waits, answers = [], [http.HttpError(429, "7"), OSError(), http.HttpError(503), b"ok"]

    def get(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert http.fetch("u", get, waits.append, jitter=lambda: 0) == b"ok" and waits == [7, 60, 120]
    assert http.backoff_schedule() == [30, 60, 120, 240, 300, 300] and http.parse_retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 0) == 60 and http.parse_retry_after("x", 0) is None
    with pytest.raises(http.HttpError):
        http.fetch("u", lambda u: (_ for _ in ()).throw(http.HttpError(404)), waits.append)
    assert http.fetch_first(["a", "b"], lambda u: b"AccessDenied" if u == "a" else b"img" * 100) == ("b", b"img" * 100)


def test_posts_source(spark, tmp_path):
    (tmp_path / "a b.json").write_text('{"title": "x"}')
    spark.dataSource.register(http.PostsSource)
    rows = spark.read.format("posts").option("base", str(tmp_path)).option("slugs", "a b,none").option("transport", "folder").load().collect()
    assert [(r.slug, r.ok) for r in rows] == [("a b", True), ("none", False)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = schema.struct("slug string, v int")
    for name, rows in (("1", '{"slug":"a","v":1}\n{"slug":"b","v":1}'), ("2", '{"slug":"b","v":2}\n{"slug":"c","v":2}')):
        (tmp_path / "in" / f"{name}.json").write_text(rows)
        ingest.ingest_stream(spark, str(tmp_path / "in"), s, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("a", 1), ("b", 1), ("c", 2)]


def test_mention_join_has_no_nested_loop_over_keyed_titles(spark):
    t = spark.createDataFrame([("t", "alpha beta")], "slug string, title string")
    d = spark.createDataFrame([("d", "alpha beta")], "slug string, text string")
    plan = xref.mention_join(t, d)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as command
from corpusloom import schema
from corpusloom.functions import frontmatter as fm
from corpusloom.functions import images
from corpusloom.functions.html import to_numbered
from corpusloom.operators import atlas, browse
from corpusloom.sources import cache, http, markdown, tables


def test_readers_of_headers(spark):
    text = '---\ntitle: ""Two" words"\nsubtitle:\n  - "x"\ntheme:\nrelated:\n- \'a\'\n- "b"\n---\n\nBody'
    h = fm.split_header(F.lit(text))["header"]
    got = spark.range(1).select(
        fm.search_scalar(h, "title").alias("s"), fm.map_scalar(h, "title").alias("m"), fm.search_scalar(h, "subtitle").alias("swallowed"), fm.map_scalar(h, "subtitle").alias("blank"),
        fm.map_items(h, "related").alias("r"), fm.map_items(h, "none").alias("n"), fm.raw_header(F.lit(text)).alias("raw"), fm.raw_header(F.lit("--- x")).alias("none"),
    ).first()
    assert got.s == '"Two" words' and got.m == 'Two" words' and got.swallowed == '- "x' and got.blank is None
    assert got.r == ["a", "b"] and got.n == [] and got.raw.body == "\nBody" and got.raw.header + "\n" + got.raw.body == text and tuple(got.none) == (None, "--- x")


def test_tags_of_one_string(spark):
    rows = [("tags: a, 'b' ,,",), ("tags: [a, b]",), ("tags:\n  - a\n  - b",), ("title: x",), (None,)]
    got = spark.createDataFrame(rows, "h string").select(fm.listed(F.col("h"), "tags").alias("t")).collect()
    assert [r.t for r in got] == [["a", "b"]] * 3 + [[]] * 2


def test_captions_and_links_of_pictures():
    html = '<figure>a<figcaption>A</figcaption></figure><img id=1><figure><figure><IMG id=2><figcaption>in</figcaption></figure><img id=3><figcaption>out</figcaption></figure><a class="image-link x" href="u?a&amp;b"><img id=4></a><figure><img id=5>'
    got = images.slots_of(html)
    assert [s["caption"] for s in got] == ["", "in", "in", "", ""] and [s["links"] for s in got] == [["u?a&b"]] * 5
    assert images.slots_of("<imgx><p>") == [] and images.slots_of(html + " " * 3000 + "<img>")[-1]["links"] == []


def test_pictures_in_order_without_repeats(spark):
    u = "https://cdn.example.com/image/"
    html = f'<img src="{u}a.png" alt="x"><img src="{u}a.png?w=1"><img src="http://elsewhere/b.png"><img data-attrs="{{oops" src="{u}c.png">'
    got = images.in_body(spark.createDataFrame([("p", html), ("q", None), ("r", "")], "slug string, html string"), "slug", "html").orderBy("n").collect()
    assert [(r.slug, r.n, r.url, r.alt, r.caption) for r in got] == [("p", 1, u + "a.png", "x", ""), ("p", 2, u + "c.png", "", "")]
    files = images.stored_files(spark.createDataFrame([("m/p/2.JPEG",), ("m/p/2.png",), ("m/p/x.png",), ("m/p/0.png",)], "path string"))
    slots = spark.createDataFrame([("p", 1), ("p", 2)], "slug string, n int")
    assert sorted(map(tuple, images.match_files(slots, files).collect())) == [("p", 1, None, None), ("p", 2, "jpg", "m/p/2.JPEG")]


def test_numbered_markdown():
    assert to_numbered("<p>a​<img></p><p>SUBSCRIBE now</p><p>Thanks for reading all!</p><ul><li><img>b</li></ul><p>Share this post too</p>") == "a\x00IMG1\x00\n\n- \x00IMG2\x00b\n\nShare this post too\n"
    assert to_numbered(None) is None and to_numbered("") == "\n"


def test_refresh_replaces_both_collections(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "t" / "one-two.md").write_text('---\nsource: "old"\ntags: "single"\nrelated:\n  - "x"\n---\n<p>Body</p>')
    (tmp_path / "t" / "_no.md").write_text("x")
    (tmp_path / "p" / "first.md").write_text("---\ntitle: First\ntags: a, b\n---\n# First\n\nText.")
    out = tmp_path / "out"
    (out / "terms").mkdir(parents=True)
    (out / "terms" / "stale.md").write_text("x")
    args = ["refresh", "--terms", str(tmp_path / "t"), "--posts", str(tmp_path / "p"), "--collection", "All", "--author", "One", "--out", str(out)]
    assert command.main(args, spark) == 0 and command.main(args, spark) == 0
    assert [p.name for p in (out / "terms").glob("*.md")] == ["one-two.md"] and "Text." in (out / "sources" / "first.md").read_text()
    term = markdown.parse_terms(markdown.read_folder(spark, str(out / "terms"))).first()
    assert (term.slug, term.letter, term.title, term.origin, term.tags, term.body_html, term.related_names) == ("one-two", "O", "one two", "old", ["single"], "<p>Body</p>", [])
    posts = markdown.parse_posts(markdown.read_folder(spark, str(out / "sources")), "All", "post", own_slug=False).first()
    assert posts.slug == "all-first" and posts.tags == ["All", "a", "b"]
    with pytest.raises(SystemExit) as e:
        command.main(["refresh", "--what"], spark)
    assert e.value.code == 2


def test_run_with_a_failed_item_keeps_the_others_and_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"slug": "a"}')
    args = ["fetch", "--base", f"file://{tmp_path}", "--slugs", "a,b", "--transport", "folder", "--out", str(tmp_path / "out")]
    with pytest.raises(http.ItemsFailed, match="1 of 2 failed: b"):
        command.main(args, spark)
    assert tables.saved_slugs(spark, str(tmp_path / "out")) == {"a"} and tables.saved_slugs(spark, str(tmp_path / "none")) == set()
    assert command.main([*args[:4], "a", *args[5:]], spark) == 0


def test_media_from_the_first_address_that_answers(spark):
    def get(url):
        if url == "bad":
            raise ValueError("gone")
        return b"x" * 300

    slots = spark.createDataFrame([("p", 1, ["bad", "good"]), ("p", 2, ["bad"])], "slug string, n int, candidates array<string>")
    got = {r.n: r for r in http.fetch_media(slots, get, 0).collect()}
    assert (got[1].url, len(got[1].body), got[1].error) == ("good", 300, None) and (got[2].url, got[2].body, got[2].error) == (None, None, "gone")


def test_search_documents_as_one_array(spark, tmp_path):
    docs = spark.createDataFrame([(f"term:{i}", "term", f"s{i}", 'a "b"', "", "c", "/u", "é\n") for i in range(9)], tables.SEARCH_DOC).repartition(3)
    path = str(tmp_path / "docs.json")
    assert tables.write_json_array(docs, path) == 9 and len(json.loads((tmp_path / "docs.json").read_text())) == 9
    assert sorted(tables.read_search_docs(spark, path).collect()) == sorted(docs.collect())
    assert tables.write_json_array(docs.limit(0), path) == 0 and json.loads((tmp_path / "docs.json").read_text()) == []


def test_cache_marks_and_rejected_rows(spark):
    kept = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y")], "slug string, html string")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "slug string")
    got = cache.read_through(wanted, kept, lambda k: k.withColumn("html", F.lit("new")))
    assert sorted(map(tuple, got.collect())) == [("a", "x", False), ("b", "new", True), ("d", "new", True)]
    marks = cache.without_images(kept, spark.createDataFrame([("c",)], "slug string"))
    assert sorted(r.slug for r in marks.collect()) == ["a", "b"] and [r.slug for r in cache.to_visit(wanted, kept, marks).collect()] == ["d"]
    rows = spark.createDataFrame([("a", " "), ("b", "t"), (None, None)], "slug string, title string")
    assert [r.missing for r in schema.rejected(rows).orderBy("slug").collect()] == [["slug", "title"], ["title"]]


def test_document_page_and_counter(spark):
    docs = spark.createDataFrame([("d", "D", "c"), ("e", "E", "c")], "slug string, title string, collection string")
    mentions = spark.createDataFrame([("t", "d"), ("u", "d"), ("gone", "d")], "term string, doc string")
    related = spark.createDataFrame([("d", "e", 1), ("d", "gone", 2)], "src string, dst string, rank int")
    terms = spark.createDataFrame([("t", "T", "T", "", "body", ["x"]), ("u", "A", "A", "", "", [])], "slug string, letter string, title string, subtitle string, text string, tags array<string>")
    page = browse.document(docs, mentions, related, terms, "d").first()
    assert [tuple(x) for x in page.terms] == [("A", "u"), ("T", "t")] and [tuple(x) for x in page.related] == [(1, "e", "E")]
    assert tuple(browse.filter_counter(terms, " BODY").first()) == (1, 2, "1 of 2", "T") and tuple(browse.filter_counter(terms, "").first()) == (2, 2, "2 terms", "A,T")


def test_headers_of_odd_texts(spark):
    """A header ends at its first line of dashes, as the pattern of the whole file has it, without matching the whole file."""
    whole = r"\A---\n([\s\S]*?)\n---\n?([\s\S]*)\z"
    texts = ["---\na: é😀\n---\nbody\n---\nmore", "---\n---\n", "---\n\n---", "---\n\n---x", "---\na\n----\nb", " ---\na\n---\n", "---\r\na\n---\n", "---\na\n---\n\n\nb", "---\na", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = rows.select("x", fm.split_header(F.col("x")).alias("s"), F.regexp_extract("x", whole, 1).alias("h"), F.regexp_extract("x", whole, 2).alias("b"), F.col("x").rlike(whole).alias("whole")).collect()
    assert [(r.s.header, r.s.body) for r in got] == [(r.h, r.b) if r.whole else (None, r.x) for r in got]
    assert "RLIKE" not in rows.select(fm.split_header(F.col("x")))._jdf.queryExecution().optimizedPlan().toString().upper()


def test_vectors_of_odd_texts(spark):
    """Texts of one key count as one, texts without a word have no vector."""
    docs = spark.createDataFrame([(1, "a b"), (1, "B c!"), (2, "..."), (3, None), (None, "a é"), (4, "b" * 9)], "id bigint, text string")
    v = atlas.text_vectors(docs, width=16)
    found = {r.id: r.embedding for r in v.collect()}
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 16
    assert set(found) == {1, None, 4} and found[None][slot("a")] == pytest.approx(1.0)
    held = [{slot("a"), slot("b"), slot("c")}, {slot("a")}, {slot("b" * 9)}]
    want = np.zeros(16)
    for w in ("a", "b", "b", "c"):
        want[slot(w)] += np.log(7 / (sum(slot(w) in h for h in held) + 1)) + 1
    assert found[1] == pytest.approx((want / np.linalg.norm(want)).tolist())
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan  # words are counted before Spark sees them one by one

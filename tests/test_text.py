import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as fm
from corpusloom.functions import images
from corpusloom.functions import text as T
from corpusloom.operators import xref
from corpusloom.plans import catalogue, library  # noqa: F401  the other registers its queries


def of(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    ("slugify", T.slugify, [("Don't `Stop` & Go!", "dont-stop-and-go"), ("  A--B  ", "a-b"), ("É’x", "x"), ("a" * 100, "a" * 80), (None, None)]),
    ("trim", T.trim, [(" ﻿ a b　", "a b"), ("", "")]),
    ("word_count", T.word_count, [("a <b>b</b> éa_1 c-d", 5), ("", 0)]),
    ("token_count", T.token_count, [("[x y](http://z) # *a*", 3)]),
    ("first_sentences", T.first_sentences, [("# *Hi* <i>you</i>", "Hi you"), ("word " * 60, ("word " * 48).strip() + "…"), ("a" * 241, "a" * 240 + "…")]),
    ("search_text", lambda x: T.search_text(x, 5), [("a_b <p>c", "a b c"), ("abcdefgh", "abcde")]),
    ("date_only", T.date_only, [("2020-01-02T03:04", "2020-01-02"), ("March 3, 2020", "March 3, 2"), ("", None), (None, None)]),
    ("decode", T.decode_entities, [("&amp;lt; &nbsp;&quot;", "&lt;  \"")]),
    ("decode_compat", lambda x: T.decode_entities(x, True), [("&amp;lt;", "<")]),
    ("md_inline", T.md_inline, [("**a** *b* [c](https://d) <", '<strong>a</strong> <em>b</em> <a href="https://d" target="_blank" rel="noopener">c</a> &lt;')]),
    ("md_block", T.md_block, [("a\nb\n\n\n c ", "<p>a b</p>\n<p>c</p>")]),
    ("norm_title", T.norm_title, [("“\"Abc'”", "abc")]),
    ("letter", T.letter, [("\"zed", "Z"), ("éa", "#"), ("9", "#")]),
    ("theme_tag", T.theme_tag, [(" Work & Play, x", "work")]),
    ("snippet", lambda x: T.snippet(x, F.lit("needle more")), [("x" * 100 + " needle <", "…" + "x" * 59 + " needle &lt;…"), ("none", "none…")]),
    ("preview", T.preview, [(" <p>ab</p> ", "ab…")]),
    ("normalize", T.normalize_markdown, [("a  \n\n\n\nb ![x](y) [](z) <i>c", "a\n\nb   c\n")]),
    ("excerpt", lambda x: T.excerpt(F.lit(" "), x), [("# h\n" + "w " * 45, "h " + " ".join(["w"] * 39) + "…")]),
    ("unquote", fm.unquote, [('"a \\"b\\""', 'a "b"'), ("'x'", "x")]),
    ("identity", images.identity, [("https://cdn.example.com/image/x%2Fpublic%2Fimages%2FA.PNG?x=1", "a.png"), ("https://z.org/a.png?b", "https://z.org/a.png")]),
    ("extension", lambda x: images.extension(x, F.lit(None)), [("https://a/b.JPEG?x", "jpg"), ("https://a/b", "jpg"), ("https://a/b.webp", "webp")]),
]


@pytest.mark.parametrize(("name", "f", "cases"), CASES, ids=[c[0] for c in CASES])
def test_scalar(spark, name, f, cases):
    assert of(spark, [a for a, _ in cases], f) == [b for _, b in cases]


def test_mention_edges_are_ascii(spark):
    df = spark.createDataFrame([("éa b", "a"), ("xa", "a"), ("a.", "a"), ("(a)", "(a)"), ("x(a)y", "(a)"), ("A+", "a+"), ("A+b", "a+")], "text string, title string")
    got = [r.m for r in df.withColumn("p", T.mention_regex(F.col("title"))).select(F.expr("text rlike p").alias("m")).collect()]
    assert got == [True, False, True, False, True, False, True]


def test_mentions_disregard_the_case_of_any_script(spark):
    rows = [("LA. ÈTION b", "La. Ètion"), ("xётионx", "Ётион"), ("aοδοσb", "ΟΔΟΣ"), ("aΟΔΟΣb", "οδος"), ("long ſtory", "Story"), ("\u212aelvin", "kelvin"), ("\u0130n", "in"), ("\u0131n", "in"), ("IN", "in"), ("éIN\u017f", "in"), ("ÈTION", "etion")]
    df = spark.createDataFrame([(f"d{i}", *r) for i, r in enumerate(rows)], "slug string, text string, title string")
    got = [r.m for r in df.withColumn("p", T.mention_regex(F.col("title"))).select(F.expr("text rlike p").alias("m")).collect()]
    assert got == [True, True, True, True, True, True, False, False, True, True, False]
    pairs = xref.mention_join(df.select(F.concat(F.lit("t"), "slug").alias("slug"), "title"), df, least=2)
    of_one = {r.doc for r in pairs.collect() if r.term == "t" + r.doc}
    assert of_one == {f"d{i}" for i, x in enumerate(got) if x}


def test_ranked_pictures(spark):
    urls = ["https://media.s3.example.com/a.png", "https://cdn.example.com/image/w_10/a.png", "https://cdn.example.com/image/a.png", "https://else.org/a.png"]
    df = spark.createDataFrame([(urls,)], "u array<string>")
    assert df.select(images.ranked(F.col("u")).alias("r")).first().r == [urls[2], urls[1], urls[0]]


def test_candidates_ignore_bad_json(spark):
    attrs = [' src="https://a/b" data-attrs="{&quot;src&quot;:&quot;https://c/d&quot;}"', ' src="https://a/b" data-attrs="{bad"', ' src="ftp://x"']
    assert of(spark, attrs, images.candidates) == [["https://a/b", "https://c/d"], ["https://a/b"], []]


def test_front_matter_lists_and_set_number(spark):
    text = '---\ntitle: "A \\"q\\""\ntags:\n  - "x"\n  - y\nmore: [a, \'b\', ]\nword_count: 3\n---\nbody word_count: 9'
    df = spark.createDataFrame([(text,), ("no header",)], "t string").withColumn("s", fm.split_header(F.col("t")))
    h = F.col("s.header")
    rows = df.select(fm.scalar(h, "title").alias("title"), fm.items(h, "tags").alias("tags"), fm.items(h, "more").alias("more"), F.col("s.body").alias("body"), fm.set_number(F.col("t"), "word_count", F.lit(7)).alias("set")).collect()
    assert rows[0].title == 'A "q"' and rows[0].tags == ["x", "y"] and rows[0].more == ["a", "b"] and rows[0].body == "body word_count: 9"
    assert rows[0].set == text.replace("word_count: 3", "word_count: 7") and rows[1].title is None and rows[1].body == "no header"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=20, max_size=20))
def test_slugify_is_idempotent_and_plain(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    once = of(spark, values, T.slugify)
    assert of(spark, once, T.slugify) == once and all(set(s) <= set("abcdefghijklmnopqrstuvwxyz0123456789-") for s in once)


def test_a_start_is_that_of_the_whole(spark):
    """Cleaned starts equal the starts of the cleaned whole, with tags and white space across the cut, and long texts aren't cleaned whole."""
    rng, pieces = random.Random(4), ["<", ">", "<b>", "a", "bc ", "  ", "\n", "#", "_*", "é😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(400)]
    clean = lambda c: T.collapse(F.regexp_replace(T.untag(c), "[#*_>`]+", " "))
    rows = spark.createDataFrame([(x,) for x in [*texts, None, "", "x" * 99]], "x string")
    for most in (1, 5, 12):
        got = rows.select(T.search_text(F.col("x"), most).alias("got"), F.substring(clean(F.col("x")), 1, most).alias("want"), T.start(F.col("x"), most, T.collapse).alias("title"), F.substring(T.collapse(F.col("x")), 1, most).alias("whole")).collect()
        assert [(r.got, r.title) for r in got] == [(r.want, r.whole) for r in got]
    assert rows.where(F.startswith("x", F.lit("xxx"))).select(T.start(F.col("x"), 5, lambda c: F.when(F.length(c) > 10, F.raise_error(F.lit("whole"))).otherwise(c)).alias("y")).first().y == "xxxxx"


def odd_documents(spark, path):
    """A folder with documents that have no text or no words, odd line ends, quotes and backslashes, and no language or source; and with a benchmark."""
    texts = [None, "", " \n\t　", "a\x85b", "\x85", "x" * 59 + "\x85y", "a b", "a\rb", '"', "'\"", 'a"', "a\\", "a\\nb", "---\n---\na", "İstanbul ΣΑΣ Σ", "\uA7CBA \u0264a B\U00010D50Σ", "a؝b⹝c", "İ" * 70 + " the and tion", "plain words"]
    kinds = [("en", "src1"), (None, "src1"), ("en", None), (None, None), ("", ""), (" e n", "src　"), ("e\nn", "s\\\nt"), ("e\\n", "s\\\\nt\\"), ("e\x85n", "s t\r"), ('"en"', "'s'"), ("- x", "[y]")]
    rows = [(i, text, lang, source) for i, (text, (lang, source)) in enumerate((t, k) for t in texts for k in kinds)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the first item"), (2, ""), (3, None), (4, "Σİ tion")], "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def equals_its_sql(spark, path, name):
    """Rows of a registered query and of its SQL over a folder, nulls and blanks apart."""
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    found, wanted = catalogue.QUERIES[name](spark, path), con.execute(catalogue.SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_headers_give_back_odd_values(spark, tmp_path):
    equals_its_sql(spark, odd_documents(spark, tmp_path), "frontmatter_roundtrip")


def test_other_readers_of_odd_values(spark, tmp_path):
    equals_its_sql(spark, odd_documents(spark, tmp_path), "header_readers")


@pytest.mark.parametrize("name", ["postings_df", "search_exact_bm25", "search_snippet"])
def test_searches_of_odd_documents(spark, tmp_path, name):
    equals_its_sql(spark, odd_documents(spark, tmp_path), name)

"""The pipeline's stages on a small table, each against what its predecessor kept."""

import numpy as np

import corpus_pipeline
from corpusloom.llm import packing
from corpusloom.llm.common import materialise


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = {"en": ["the", "house", "with", "think", "ring", "from", "water"], "de": ["schön", "nicht", "zeit", "über", "und", "haus", "wasser"]}
    texts = [" ".join(f"{w}{''.join(rng.choice(list('aeiou'), 2))}" for w in rng.choice(words[("en", "de")[i % 2]], 60)) for i in range(60)]
    rows = [(i, t, ("en", "de")[i % 2]) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "de"), (101, texts[4] + " more", "en"), (102, None, "en"), (103, "12 34 !!", "en"), (104, texts[5] + " mail a.b@c.org now", "de")]
    df = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "private_data", "best_fit_packing"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["language_id"]} == {*range(60), 100, 101, 104}
    assert {r.doc_id for r in kept["near_dedup"]} == set(range(60))
    assert kept["language_id"][0].__fields__ == kept["private_data"][0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in kept["private_data"]) and {r.doc_id: r.text for r in kept["private_data"]} == dict(enumerate(texts))
    again = packing.pieces(spark.read.parquet(f"{tmp_path}/private_data"), packing.default_vocabulary())
    cut = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert cut(again.collect()) == cut(kept["best_fit_packing"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece").collect())) == sorted((r.doc_id, r.piece) for r in kept["best_fit_packing"])


def test_stages_on_odd_rows(spark, tmp_path):
    """Ids that are null or repeated, clashing columns, and an empty table."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "house", "with", "think", "ring", "from", "water", "stone"], 40)) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (3, texts[3], "en"), (None, texts[5], "en"), (None, texts[5], "en"), (40, texts[6], "en"), (41, None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, rejected boolean, score int, lang_pred string, component_id int, kept boolean, key string, place int"
    df = spark.createDataFrame([(i, t, l, "s", 0, True, 7, "xx", 1, False, "k", 1) for i, t, l in rows], names)
    for docs, want in ((df, [None, None, *range(30)]), (df.where("doc_id = -1"), [])):
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == df.columns
            docs = materialise(out, "stage")
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x)) == want
        assert corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len(set(want))

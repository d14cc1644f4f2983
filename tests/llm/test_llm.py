"""Each operator against brute force on a small table of odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, language, licenses, media, near_dup, packing, pii, topk, warc
from corpusloom.llm.common import shared_folder

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a", "Hello, world! it's 12 o'clock", "é😀 日本 <|endoftext|>", "x" * 20_000, LONG, LONG, "Hello, world! it's 12 o'clock"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "piece", "key", "rep", "band") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, piece string, key string, rep string, band string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_bpe_as_the_library(docs, empty):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(docs, path, pattern).collect():
        ids = own.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, path, pattern).count() == 0
    tree = bpe.SegmentTreeBPE(ranks, pattern)
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 65, 300):
        raw = bytes(rng.choice([97, 98, 99, 195, 169], n).astype(np.uint8))
        if raw not in ranks and n <= 64:
            size = 1 << max(1, (n - 1).bit_length())
            assert np.frombuffer(tree.merge_rows([raw], size)[0], "<u4").tolist() == tree.merge(raw)
        assert tree.decode_bytes(tree.merge(raw)) == raw


def test_packing_is_whole_and_tight(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_tokens_of_strange_texts_as_the_library(spark):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["a <|endoftext|> b", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> \n<|endoftext|>\t x", "  <|endoftext|>  <|endoftext|> ", "don't  stop\u00a0é e\u0301", "I'm <|endoftext|>'s"]
    for text, packed in zip(texts, own.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    rows = packing.pack_documents(spark.createDataFrame([(7, "one id of many rows")] * 50, "doc_id bigint, text string"), path).collect()
    assert len(rows) == 50 and len({r.sequence_id for r in rows}) == 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    n = np.sort(np.random.default_rng(1).integers(1, 60, 400))[::-1]
    which, offset = packing.best_fit(n, 100, 4, 5000, rule=rule)
    for s in set(which):
        own = n[which == s]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 5000
        assert sorted(offset[which == s]) == sorted(np.cumsum([0, *own[np.argsort(offset[which == s])][:-1]]))


def test_media_round_trip(docs, empty):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(TEXTS) and media.media_columns(empty).count() == 0
    for r in rows:
        data = (TEXTS[r.doc_id] or "").encode()
        payload = media.pad(data)
        stored = media.wav_header(len(payload)) + payload
        assert len(payload) % 192 == 0 and len(payload) >= 192 and media.wav_samples(stored) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
    shared, a, b = bytes(np.random.default_rng(2).integers(0, 256, 60_000, np.uint8)), b"head", b"another head of more bytes"

    def parts(p):
        ends = media.cuts(p)
        return {p[i:j] for i, j in zip([0, *ends], ends)}

    assert len(parts(a + shared) & parts(b + shared)) > 15
    assert all(len(p) <= media.MOST for p in parts(b"\x00" * 100_000))


def test_warc(spark):
    big, other = "é" * 60, "z" * 99
    rows = [(5, "http://B.example.com:80/x y?q", big), (3, "https://a.example.com/", big), (9, "https://a.example.com/", big), (1, None, None), (2, "http://a/", other), (4, "http://a/", other), (7, "nonsense\r\nX: y", "a\r\n\r\nb" * 40), (None, "http://n/", big), (9, "https://a.example.com/", big), (9, "https://a.example.com/", "w" * 200)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, key string, kind int")
    folder = shared_folder(spark, "warc")
    top = warc.write_archives(pages, folder)
    got = sorted(map(tuple, warc.look_up(pages, folder, top).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h == big and i is not None and i > 3
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.look_up(pages.limit(1).withColumn("url", F.lit("http://none/")), folder, top).count() == 0
    none = shared_folder(spark, "warc")
    assert warc.look_up(pages, none, warc.write_archives(pages.where("page_id < 0"), none)).count() == 0


def brute_groups(texts, words, least):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    texts = list(TEXTS[:7])
    for b in base:
        for _ in range(5):
            w = b.split()
            for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[k] = "X"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, component int")
    got = [(r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=4).orderBy("doc_id").collect()]
    assert got == brute_groups(texts, 4, 80)
    assert near_dup.near_duplicates(empty).count() == 0
    assert [r.kept for r in near_dup.near_duplicates(docs).orderBy("doc_id").collect()] == [True] * 8 + [False] * 2


def test_joint_estimate_is_near():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.8, 0.95):
        x = rng.integers(0, 2**63, 3000).astype(np.uint64)
        both = int(3000 * 2 * j / (1 + j))
        y = np.concatenate([x[:both], rng.integers(0, 2**63, 3000 - both).astype(np.uint64)])
        a, b = near_dup.sketch(x), near_dup.sketch(y)
        e = near_dup.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([3000.0]), np.array([3000.0]), near_dup.REGISTERS)[0]
        assert abs(e - j) < 0.1


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """One group around a text that few of its copies are similar enough to, so that links have to be found between copies, in blocks of a few members."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, len(w), int(rng.integers(4, 9))):
            w[k] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=4).orderBy("doc_id").collect()]
    want = brute_groups(texts, 4, 80)
    assert got == want and 1 < len({c for _, c in want}) < 90


def test_language(spark, docs, empty):
    words = {"en": ["the", "house", "with", "think", "ring"], "de": ["schön", "nicht", "zeit", "über", "und"]}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[l], 12)), l) for i in range(300) for l in [("en", "de")[i % 2]]]
    df = spark.createDataFrame([*rows, (1000, None, None), (1001, "123 !?", "en"), (1002, "the house", None)], "doc_id bigint, text string, lang string")
    model = language.fit(df.where(~language.held_out()))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows) and not any(got[i].rejected for i, _, _ in rows)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1001].rejected and got[1002].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    none = language.fit(empty)
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_language_rejects_at_any_length(spark):
    words = {"en": ["the", "house", "with", "think", "ring"], "de": ["schön", "nicht", "zeit", "über", "und"]}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[l], 40)), l) for i in range(100) for l in [("en", "de")[i % 2]]]
    model = language.fit(spark.createDataFrame([*rows, (200, "ja", "xx")], "doc_id bigint, text string, lang string"))
    assert (model.least > 0).all() and model.least.shape[1] == language.CLASSES
    foreign = ["Москва", "Б", "это длинный текст " * 20_000, "zqx vkj pqf " * 50_000]
    own = ["the", "und", "the house with ", "the house with think ring " * 20_000, "schön nicht zeit über und " * 20_000]
    assert [r for _, _, r in model.predict(foreign)] == [True] * 4
    assert [r for _, _, r in model.predict(own)] == [False] * 5


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(x):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(q) > 255 for q in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


HARD = ["a@b.c@d.e", "a@b.c_d@e.f", "x@y@z.com", "1.2.3.4.5", "256.1.1.1 1.1.1.1", "001.002.003.004", "+1 (988) 555-2485 +4", "4111 1111 1111 1111", "é😀a.b@c-d.e.f x", "a" * 2000 + "@b.c", "1" * 5000, "1 " * 3000, "+1" + "(" * 2000, "..@..", "4111111111111111@q.w", None, "", "a@b." * 300 + "c"]


def test_private_data(spark, empty):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)], "doc_id bigint, text string, base int")
    rows = pii.find_personal_data(df).orderBy("doc_id").collect()
    for r, t in zip(rows, HARD, strict=True):
        want = brute_spans(t or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want
        assert [r[f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]
    assert pii.find_personal_data(empty).count() == 0 and pii.sanitise(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[2] == "x@[EMAIL]" and clean[6] == "[PHONE] +4" and clean[15] is None and clean[16] == ""


def test_running_sums_and_maxima(spark):
    values = [[], [5], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], list(range(100, 0, -1))]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v array<int>")
    got = df.select("i", pii.running(F.col("v"), pii.total).alias("s"), pii.running(F.col("v"), pii.largest).alias("m")).orderBy("i").collect()
    for r, v in zip(got, values, strict=True):
        assert r.s == [sum(v[:i]) for i in range(len(v))] and r.m == [max([0, *v[:i]]) for i in range(len(v))]


def test_many_addresses_in_one_text(spark):
    text = " ".join(f"user{i}@host{i}.org word{i}" for i in range(6000))
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    r = pii.find_personal_data(df).first()
    assert r.n_email == 6000 and r.base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest()


def test_addresses_and_words_of_one_text_are_one_pair(spark, monkeypatch):
    """Twice as many addresses and words of a text give the same few pairs of sets."""
    written, rows = pii.materialise, {}

    def counted(df, what):
        out = written(df, what)
        rows[what] = rows.get(what, 0) + (out.count() if what == "pairs" else 0)
        return out

    monkeypatch.setattr(pii, "materialise", counted)
    plain, found = [f"plain text {i} of common words" for i in range(200)], []
    for n in (100, 5000):
        rows.clear()
        text = " ".join(f"user{i}@host{i}.org word{i}" for i in range(n))
        r = pii.find_personal_data(spark.createDataFrame(list(enumerate([*plain, text])), "doc_id bigint, text string")).where("doc_id = 200").first()
        spans = r.spans.split(",")
        # the words beside the addresses are disclosed, those within them are no spans of their own
        assert r.n_email == n and sum(s.startswith("term:") for s in spans) == n and len(spans) == 2 * n
        found.append(rows["pairs"])
    assert found[0] == found[1] <= 4


def brute_terms(texts):
    """Terms of each text by d(e, t), counted over distinct texts, as the docstring of pii says."""
    entities = {t: {(k, v.lower()) for k, v in re.findall(r"()(\w+@\w+\.org)", t)} for t in set(texts)}
    words = {t: {w for w in re.split(r"[^\w]+", t.lower()) if 2 <= len(w) <= 64 and not re.fullmatch("[0-9]+", w)} for t in set(texts)}
    # copies of texts with personal data count once, other copies each
    n = len([t for t in texts if not entities[t]]) + len([t for t in set(texts) if entities[t]])
    times = {t: 1 if entities[t] else texts.count(t) for t in set(texts)}
    df = {}
    for t, ws in words.items():
        for w in ws:
            df[w] = df.get(w, 0) + times[t]
    out = {}
    for t in set(texts):
        for e in entities[t]:
            having = [x for x in entities if e in entities[x]]
            info = -np.log2(len(having) / n)
            for w in words[t]:
                n_et = sum(w in words[x] for x in having)
                if info > 0 and np.log2(n_et * n / (len(having) * (df[w] + pii.UNSEEN))) / info >= pii.GENERALISE:
                    out.setdefault(t, set()).add(w)
    return out


def test_terms_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    common, rare = [f"common{i}" for i in range(30)], [f"rare{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = [*rng.choice(common, 12), *rng.choice(rare, 2)]
        if i % 5 == 0:
            who = int(rng.integers(0, 8))
            w += [f"name{who}", f"p{who}@corp.org"]
        texts.append(" ".join(rng.permutation(w)))
    texts += texts[:10] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, fired = brute_terms(texts), 0
    for r in pii.find_personal_data(df).collect():
        text = texts[r.doc_id]
        found = {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind == "term"}
        base = {(int(a), int(b)) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind != "term"}
        inside = {w for a, b in base for w in re.findall(r"\w+", text[a:b])}
        assert found == want.get(text, set()) - inside
        fired += bool(found)
    assert fired > 20


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"word{i} Marvin wrote to m.s@corp.org about thing{i}") for i in range(6)] + [(100 + i, f"text {i} about what was wrote to") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert spans[3] == "term:6:12,email:22:34" and spans[101] == ""
    assert pii.sanitise(df).where("doc_id = 3").first().text == "word3  wrote to [EMAIL] about thing3"
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(9)], "doc_id bigint, text string")
    assert {r.spans for r in pii.find_personal_data(copies).collect()} == {"email:22:34"}


def test_terms_of_an_entity_that_occurs_once(spark):
    rows = [(0, "Dear Zaphod write to z.b@corp.org about this"), (1, "Dear Zaphod write to z.b@corp.org about this"), *((2 + i, "Dear all write to us about this") for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert spans[0] == spans[1] == "term:5:11,email:21:33" and spans[2] == ""


def test_terms_far_from_an_entity(spark):
    text = "Dear İzaphod " + "write to us about this " * 3000 + "at z.b@corp.org"
    rows = [(0, text), *((1 + i, "Dear all write to us about this at") for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert spans[0] == f"term:5:12,email:{len(text) - 12}:{len(text)}" and spans[1] == ""


def test_top_k(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:90] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [float("nan")] * 6), (400, [None] * 6), (450, []), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = np.floor(x * 256).astype(int)
    for q in range(0, 300, 50):
        want = sorted(((j, int(v[q] @ v[j])) for j in range(300) if j != q), key=lambda t: (-t[1], t[0]))[:5]
        assert got.pop(q) == want
    assert not got


def test_top_k_of_repeated_queries_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(100, 4)).round(2)
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), (50, x[50].tolist()), (200, [1e300, 0.0, 0.0, 0.0]), (250, [1e300, -1e300, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    clip = lambda z: min(2**63 - 1, max(-(2**63), z))
    v = [(i, [int(np.floor(c * 256)) if abs(c) < 1e15 else clip(int(c)) for c in e]) for i, e in rows]
    want = []
    for q, a in v:
        if q % 50 == 0:
            scored = sorted(((sum(c * d for c, d in zip(a, b)), i) for i, b in v if i != q), key=lambda t: (-t[0], t[1]))[:5]
            want += [(q, k + 1, clip(score)) for k, (score, _) in enumerate(scored)]
    got = [(r.query_id, r["rank"], r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("vec_id < 0"), df.where("vec_id < 0"), 5).count() == 0


def test_licenses(spark, empty):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    rows = [*texts, *licenses.OTHERS, None, "", "x\nLicensed under the MIT License.\ny\nLicensed under CC BY 4.0.", "Some words, licensed " * 3000]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(rows)], "doc_id bigint, text string, row string, line int")
    got = [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [*families, *[""] * (len(licenses.OTHERS) + 2), "CC-BY,MIT", ""]
    assert licenses.scan(empty).count() == 0


WRAPPED = {
    "GPL": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
}


def test_licenses_wrapped_over_lines(spark):
    """Notices as files hold them, in words that differ here and there from the training texts, between other paragraphs."""
    rows = [f"Some words about a thing\n\n{t}\n\nOther words.\n" for t in WRAPPED.values()] + ["License: MIT. Released under the MIT License\nand more text without an end\nthat goes on and on about the weather of the week"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [*WRAPPED, "MIT"]


def test_license_scores_equal_a_plain_scorer(spark):
    classes, grams, weights, intercepts = licenses.train()
    at = {g: i for i, g in enumerate(grams)}
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + [t.replace("\n", " ") for t in WRAPPED.values()] + licenses.OTHERS
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t.rstrip(".")) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()}
    told = 0
    for i, t in enumerate(texts):
        found = licenses.grams_of(licenses.words_of(t))
        score = np.array(intercepts) + sum((weights[at[g]] for g in found if g in at), np.zeros(len(classes)))
        p = licenses.soft(score[None])[0]
        own, family = set(licenses.two_grams_of(t)), classes[int(p.argmax())]
        both = [len(own & set(licenses.two_grams_of(x))) >= licenses.ALIKE * min(len(own), len(licenses.two_grams_of(x))) for x in licenses.TEMPLATES.get(family, [])]
        want = family if p.max() >= licenses.PROBABLE and any(both) else ""
        assert got[i].licenses == want
        if want:
            told += 1
            assert abs(got[i].top_probability - p.max()) < 1e-5
    assert told > 30


def test_license_probabilities_are_calibrated():
    """Expected calibration error of texts that the weights haven't seen: the wrapped notices and other sentences."""
    classes, grams, weights, intercepts = licenses.train()
    at = {g: i for i, g in enumerate(grams)}
    unseen = [*((t, f) for f, t in WRAPPED.items()), ("Content under CC BY 4.0.", "CC-BY"), ("Available under CC BY-SA 4.0.", "CC-BY-SA"), ("The weather was fine in the morning.", "unknown"), ("He wrote a letter to the committee.", "unknown")]
    sure, right = [], []
    for t, f in unseen:
        score = np.array(intercepts) + sum((weights[at[g]] for g in licenses.grams_of(licenses.words_of(t)) if g in at), np.zeros(len(classes)))
        p = licenses.soft(score[None])[0]
        sure.append(p.max())
        right.append(classes[int(p.argmax())] == f)
    assert np.mean(right) >= 0.75 and abs(np.mean(sure) - np.mean(right)) < 0.3


def test_licenses_in_words_of_their_own(spark):
    rows = ["Available under CC BY-SA 4.0.", "Content under CC BY 4.0.", "Released under Apache 2.0.", "Code: BSD-3-Clause.", "under the terms of the", "to the", "one", "-"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == ["CC-BY-SA", "CC-BY", "Apache-2.0", "BSD", "", "", "", ""]
    assert {r.n_anchored for r in got} == {0}


def test_confirmable_lines_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    words = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)})
    templates = [set(licenses.two_grams_of(t)) for ts in licenses.TEMPLATES.values() for t in ts]
    lines = [*(t[i:j] for ts in licenses.TEMPLATES.values() for t in ts for i, j in rng.integers(0, len(t) + 1, (4, 2))), *(" ".join(rng.choice(words, n)) for n in range(9)), "of the", "the", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i bigint, line string")
    got = [r.c for r in df.select("i", licenses.confirmable(F.col("line")).alias("c")).orderBy("i").collect()]
    own = [set(licenses.two_grams_of(t)) for t in lines]
    assert got == [any(len(g & t) >= max(1, licenses.ALIKE * min(len(g), len(t))) for t in templates) for g in own]
    assert any(got) and not all(got)


def test_chat(spark):
    call = lambda *c: json.dumps({"content": "hm", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'hi "x"\n'), (1, 1, "tool", result("a", "early")), (1, 2, "assistant", call(("a", "search", {"query": "q", "limit": 3}), ("b", "search", {"limit": "x", "z": {"b": 1, "a": [2.5, None]}}))),
        (1, 3, "tool", result("b", "ok")), (1, 4, "assistant", call(("a", "nope", {}))), (1, 5, "tool", result("zz", "?")), (2, 0, "assistant", "{not json"), (2, 1, None, None), (None, 2, "tool", result("a", "x")),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, name string")
    out = chat.format_messages(df, chat.TOOLS).where("conv_id = 1").orderBy("order_turn", "order_rank", "turn").collect()
    assert [r.turn for r in out] == [0, 2, 1, 3, 4, 5] and [r.linked for r in out] == [None, None, True, True, None, False]
    assert out[1].n_calls == out[1].n_answered == 2
    assert out[1].problems == ["search limit: not of its type", "search query: missing", "search z: not in the schema"] and out[4].problems == ["nope unknown tool", "nope an id used before"]
    assert '"arguments":{"limit":"x","z":{"a":[2.5,null],"b":1}}' in out[1].message
    for r in out:
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    assert chat.format_messages(df, chat.TOOLS).count() == len(rows) and chat.format_messages(df.where("turn > 9"), {"t": {}}).count() == 0


def brute_links(conversation):
    """order of the turns, what links, and the calls with their problems, by dictionaries."""
    first, out = {}, {}
    calls = sorted((turn, k, c) for turn, role, body in conversation if role == "assistant" and body for k, c in enumerate(body))
    for turn, k, c in calls:
        if c[0] is not None:
            first.setdefault(c[0], (turn, k))
    answered = {body for _, role, body in conversation if role == "tool"}
    order = []
    for turn, role, body in conversation:
        if role == "tool":
            at = first.get(body, (None,))[0]
            order.append((max(turn, at) if at is not None else turn, int(at is not None and at >= turn), turn))
            out[turn] = ("result", at is not None)
        elif body:
            order.append((turn, 0, turn))
            found = []
            for k, (i, name, given) in enumerate(body):
                if name == "search":
                    kinds = {a: type(v) for a, v in given.items()}
                    found += sorted([f"search {a}: not in the schema" for a in kinds if a not in ("query", "limit")] + [f"search {a}: not of its type" for a, t in (("query", str), ("limit", int)) if a in kinds and kinds[a] is not t] + ["search query: missing"] * ("query" not in kinds))
                else:
                    found.append(f"{name} unknown tool")
                if i is None:
                    found.append(f"{name} no id")
                elif first[i] != (turn, k):
                    found.append(f"{name} an id used before")
            out[turn] = ("call", len(body), sum(i in answered for i, _, _ in body), found)
        else:
            order.append((turn, 0, turn))
            out[turn] = ("plain",)
    return [t for *_, t in sorted(order)], out


def test_linked_conversations_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    conversations, rows = {}, []
    for conv in range(40):
        turns = []
        for turn in range(int(rng.integers(1, 12))):
            role = pick("user", "assistant", "tool")
            if role == "tool":
                body = pick("a", "b", "c", "zz")
                text = json.dumps({"tool_call_id": body, "content": "ok"})
            elif role == "assistant" and rng.random() < 0.7:
                body = [(pick("a", "b", "c", None), pick("search", "search", "nope"), {a: pick("x", 3, [1], True) for a in ("query", "limit", "more") if rng.random() < 0.5}) for _ in range(int(rng.integers(1, 4)))]
                text = json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": g} for i, n, g in body]})
            else:
                body, text = None, "words"
            turns.append((turn, role, body))
            rows.append((conv, turn, role, text))
        conversations[conv] = turns
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), chat.TOOLS)
    got = {}
    for r in out.orderBy("conv_id", "order_turn", "order_rank", "turn").collect():
        got.setdefault(r.conv_id, []).append(r)
    for conv, turns in conversations.items():
        order, want = brute_links(turns)
        assert [r.turn for r in got[conv]] == order
        for r in got[conv]:
            w = want[r.turn]
            if w[0] == "call":
                assert (r.n_calls, r.n_answered, sorted(r.problems)) == (*w[1:3], sorted(w[3]))
            assert r.linked == (w[1] if w[0] == "result" else None)


def test_arguments_that_are_no_object(spark):
    call = lambda arguments: '{"tool_calls":[{"id":"a","name":"search","arguments":' + arguments + "}]}"
    texts = [call('"q"'), call("[1]"), call('{"query":"q","query":"r"}'), call('"{\\"query\\":\\"q\\"}"'), '{"tool_calls":[{"id":"a","arguments":{"query":"q"}}]}']
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), chat.TOOLS).orderBy("conv_id").collect()
    unread = ["search arguments: not JSON, or with a repeated key"]
    assert [r.problems for r in out] == [unread, ["search arguments: not an object"], unread, [], ["unknown tool", "no name"]]
    assert [json.loads(r.message)["tool_calls"][0]["arguments"] for r in out] == ["q", [1], '{"query":"q","query":"r"}', {"query": "q"}, {"query": "q"}]

"""Near-duplicate groups by SetSketch registers, bands and confirmed links.

A document is the set of its distinct word shingles. Its sketch has REGISTERS values: the least of
the set's hashes under each of REGISTERS hash functions, on an exponential scale of base BASE,
truncated to a byte; the sketch of a union is the greater register of each pair. Two sets agree in a
register with a probability of about their similarity, so BANDS bands of WIDTH registers collide
nearly always at 0.8: a pair with similarity s is missed with probability (1 - s**WIDTH)**BANDS,
7e-6 at 0.8, 3e-8 at 0.85. Pairs that share a band are estimated by the maximum of the joint likelihood of their
registers, given both set sizes, and confirmed on full sets if the estimate is within five standard
errors of the threshold.

At scale: copies of a set become one class first, by an aggregation that combines before the shuffle.
A band's members are compared with its smallest member, not with each other, and each with the
STARS of those that it meets in most bands: as many pairs as members, whatever the groups. Components
of the confirmed links follow by alternating stars. Only in bands that still hold several components
are members compared across components, in two passes over blocks:

- by sketches alone, in blocks of BLOCK members, which name the members that may have a partner in
  another component, one row per member and block at most;
- with their full sets, in blocks of BLOCK_BYTES of these, which confirm inside the block and give a
  spanning forest of confirmed links: fewer rows than members, however many pairs are similar.

A pair counts in the first of the bands that it shares, so no pair is estimated or confirmed twice.
Comparisons of sketches in a mixed band grow with its members outside the largest component times its
size; rows don't. Joins on hot keys are sort-merge joins that Spark splits. Every round is a table in
the shared folder; tables that nothing reads any more are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise, table

#: Words of a shingle and least similarity in hundredths, where a contract doesn't say otherwise.
WORDS, LEAST = 5, 80
BANDS, WIDTH, BASE = 30, 5, 1.1
#: Registers that estimate; the bands take the first BANDS * WIDTH of them.
REGISTERS = 200
#: Standard errors below the threshold at which an estimate still counts.
ERRORS = 5
#: Smallest members of its bands that a class is confirmed with at first.
STARS = 2
#: Members of a band whose sketches are compared at a time, and bytes of full sets that are.
BLOCK, BLOCK_BYTES = 2048, 16 << 20

SKETCHES = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sketch binary"
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def byte_words() -> np.ndarray:
    """A word per byte, A-Z as a-z, from the splitmix64 rule."""
    out = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    out[65:91] = out[97:123]
    return out


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 2 * n)
        p = 0x9E3779B97F4A7C15
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, q, U64), dtype=U64)]) for q in (p, pow(p, -1, 1 << 64))]
    return _powers[0], _powers[1]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; the whole sequence is one if it has fewer words."""
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    black = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edges = np.flatnonzero(black[1:] != black[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(byte_words()[data] * up[: len(data)], dtype=U64)])
    w = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, k, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + w[j : len(w) - k + 1 + j]
    return np.unique(mix(out))


def sketch(found: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of a non-empty set of hashes; fewer registers are the first of more."""
    x = (found >> U64(32)).astype(np.uint32)
    a = mix(np.arange(1, registers + 1, dtype=U64))
    odd, add = (a >> U64(32)).astype(np.uint32) | np.uint32(1), a.astype(np.uint32)
    least = np.full(registers, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * odd + add
        h ^= h >> np.uint32(16)
        np.minimum(least, h.min(0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)) + 8, 0, 255).astype(np.uint8)


def estimate(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray, registers: int) -> np.ndarray:
    """Similarity of the greatest joint likelihood, to 0.01. more, less: how many of the first set's registers are greater, smaller."""
    u = n1 / (n1 + n2)
    top = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    j = np.linspace(0, 1, 101)[None, :] * top[:, None]
    p = lambda x: np.clip(-np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)
    a, b = p(u[:, None] - (1 - u)[:, None] * j), p((1 - u)[:, None] - u[:, None] * j)
    score = more[:, None] * np.log(a) + less[:, None] * np.log(b) + (registers - more - less)[:, None] * np.log(np.clip(1 - a - b, 1e-12, 1))
    return j[np.arange(len(j)), score.argmax(1)]


def lowest(registers: int, least: int) -> float:
    """The estimate that a pair at the threshold falls below with five standard errors only."""
    s = least / 100
    return s - ERRORS * (s * (1 - s) / registers) ** 0.5


def passes(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: int, band: int | None = None) -> np.ndarray:
    """Estimates of pairs of sketches, 0 for those that can't reach the threshold or share a band before the given one."""
    out, registers = np.zeros(len(n1)), a.shape[1]
    near = np.flatnonzero(100 * np.minimum(n1, n2) >= least * np.maximum(n1, n2))
    # registers agree at least as often as the sets are similar
    equal = a[near] == b[near]
    enough = equal.sum(1) >= lowest(registers, least) * registers
    near, equal = near[enough], equal[enough]
    if band is not None:
        first = equal[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).all(2).argmax(1) == band
        near = near[first]
    if len(near):
        x, y = a[near], b[near]
        score = estimate((x > y).sum(1), (x < y).sum(1), n1[near].astype(float), n2[near].astype(float), registers)
        out[near] = np.where(score >= lowest(registers, least), score, 0)
    return out


def linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= least * (len(x) + len(y) - both)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), words)
                if len(s):
                    rows.append((doc_id, len(s), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)), int(mix(s ^ U64(0x14057B7EF767814F)).sum(dtype=U64).astype(np.int64)), sketch(s).tobytes()))
                else:
                    rows.append((doc_id, 0, None, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCHES)


def bands(classes: DataFrame) -> DataFrame:
    """(band, rep): a band is its number and its registers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = matrix(batch.column(1))[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).astype(np.int64)
            key = (np.arange(BANDS, dtype=np.int64) << 40) + (s << (8 * np.arange(WIDTH))).sum(2)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["band", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "band bigint, rep bigint")


def matrix(column: pa.Array, registers: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, registers)


def likely(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of classes whose sketches may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = passes(matrix(batch.column("sa")), matrix(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), least)
                yield batch.select(["a", "b"]).filter(pa.array(score > 0))

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=16)
        def full(text: str) -> np.ndarray:
            return shingles(text, words)

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                ok.append(linked(full(x.as_py()), full(y.as_py()), least))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    asked = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    texts = materialise(texts.join(asked.hint("merge"), "rep", "left_semi").dropDuplicates(["rep"]), "texts")
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of every node of the links (a, b): the smallest node reachable. By alternating large and small stars."""
    edges = materialise(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m"))).select(F.col("v").alias("u"), F.col("m").alias("w"))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").where("v <> m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        joined = large.join(least, "v")
        small = joined.select("v", F.col("least").alias("m")).union(joined.where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))).where("v <> m").distinct()
        before, edges = edges, materialise(small, "edges")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    # a star per component now: its centre is the least node
    return edges.select(F.col("v").alias("rep"), F.col("m").alias("component")).union(edges.select(F.col("m").alias("rep"), F.col("m").alias("component"))).groupBy("rep").agg(F.min("component").alias("component"))


def mixed(rows: DataFrame) -> DataFrame:
    """The rows of bands that hold several components, with ``major``: in their band's largest one."""
    parts = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    several = several.select("band", F.col("top.component").alias("largest"))
    return rows.join(several.hint("merge"), "band").withColumn("major", F.col("component") == F.col("largest")).drop("largest")


def dealt(rows: DataFrame, size: Column, block: int) -> DataFrame:
    """The rows as often as their band's blocks meet: (band, kind, i, j) names two blocks.

    Of kind 0 are a block of the largest component and one of the others', of kind 1 two of the others'.
    A block holds about ``block`` of the given size; ``own`` is a row's own block.
    """
    sizes = rows.groupBy("band").agg(*(F.coalesce(F.sum(F.when(F.col("major") == x, size)), F.lit(0)).alias(n) for x, n in ((True, "majors"), (False, "minors"))))
    blocks = [F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int").alias(n) for n in ("majors", "minors")]
    rows = rows.join(sizes.select("band", *blocks).hint("merge"), "band")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = [c for c in rows.columns if c not in ("band", "majors", "minors")]
    major = rows.where("major").select("band", F.lit(0).alias("kind"), own("majors").alias("i"), every("minors").alias("j"), F.lit(0).alias("own"), *carried)
    minor = rows.where("not major")
    outer = minor.select("band", F.lit(0).alias("kind"), every("majors").alias("i"), own("minors").alias("j"), F.lit(0).alias("own"), *carried)
    inner = minor.withColumn("o", every("minors")).withColumn("own", own("minors"))
    inner = inner.select("band", F.lit(1).alias("kind"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", *carried)
    return major.unionByName(outer).unionByName(inner)


def by_blocks(rows: DataFrame, run: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` of the key and the rows of each two blocks; one stream per partition, as most groups are tiny."""
    keys = ["band", "kind", "i", "j"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held: list[pa.RecordBatch] = []
        done: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
            starts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]]).tolist()
            for at, end in zip(starts, starts[1:], strict=False):
                key = tuple(k[:, at].tolist())
                if key != last and held:
                    done.append(run(last, pa.Table.from_batches(held)))
                    held = []
                last = key
                held.append(batch.slice(at, end - at))
            if sum(t.num_rows for t in done) >= 1024:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if held:
            done.append(run(last, pa.Table.from_batches(held)))
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    # a fixed number, as the work of a block is no matter of its bytes, by which Spark would merge partitions
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def candidates(key: tuple, found: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Members of two blocks that lie outside the largest component, with the members of other components that may reach the threshold and their estimates."""
    band, kind, i, j = key
    component, n, major, own = (found[c].to_numpy() for c in ("component", "n_shingles", "major", "own"))
    s = matrix(found["sketch"])
    at = np.arange(len(n))
    for x in np.flatnonzero(~major).tolist():
        ok = (component != component[x]) & (100 * np.minimum(n, n[x]) >= least * np.maximum(n, n[x]))
        if kind == 0:
            ok &= major
        else:
            ok &= (at > x) if i == j else (own != own[x]) & (at > x)
        others = np.flatnonzero(ok)
        if len(others):
            score = passes(np.broadcast_to(s[x], (len(others), s.shape[1])), s[others], np.full(len(others), n[x]), n[others], least, band >> 40)
            good = score > 0
            if good.any():
                yield x, others[good], score[good]


def hopeful(rows: DataFrame, least: int) -> DataFrame:
    """(band, rep) of the members with a partner in another component of their band, by sketches."""

    def run(key: tuple, found: pa.Table) -> pa.Table:
        keep = np.zeros(found.num_rows, bool)
        for x, others, _ in candidates(key, found, least):
            keep[x] = keep[others] = True
        return found.select(["band", "rep"]).filter(pa.array(keep))

    blocks = dealt(rows, F.lit(1), BLOCK)
    return by_blocks(blocks, run, "band bigint, rep bigint").distinct()


def forests(rows: DataFrame, least: int) -> DataFrame:
    """Links (a, b) of full sets (a column of sorted hashes, packed) across components: a spanning forest of each two blocks."""

    def run(key: tuple, found: pa.Table) -> pa.Table:
        rep, component, sets = found["rep"].to_numpy(), found["component"].to_numpy(), found["hashes"]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        full = lambda at: np.frombuffer(sets[at].as_py(), U64)
        out: list[tuple[int, int]] = []
        for x, others, score in candidates(key, found, least):
            mine = None
            # the most similar first, as one link is enough for each component
            for y in others[np.lexsort((rep[others], -score))].tolist():
                if root(int(component[x])) == root(int(component[y])):
                    continue
                mine = full(x) if mine is None else mine
                if linked(mine, full(y), least):
                    parent[root(int(component[x]))] = root(int(component[y]))
                    out.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    blocks = dealt(rows, F.col("n_shingles") * 8 + REGISTERS, BLOCK_BYTES)
    return by_blocks(blocks, run, "a bigint, b bigint").distinct()


def full_sets(reps: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """rep and the sorted hashes of its shingles, packed, of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "hashes"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    return texts.join(reps.hint("merge"), "rep", "left_semi").dropDuplicates(["rep"]).mapInArrow(run, "rep bigint, hashes binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id linked with it, directly or not), kept.

    Links join documents whose sets' intersection is least hundredths of their union or more. A text
    that is null, empty or has no words has no shingles and is linked with nothing. Rows that share
    an id are copies of one document and get the same values; an empty table gives no rows. Ids that
    are null are linked with nothing and kept. An id is taken to name one text. Only the two columns
    named are read.
    """
    one = materialise(sketches(docs, words, id_col, text_col), "sketches")
    classes = one.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "sketch")).alias("x")).select("h1", "h2", "n_shingles", F.col("x.doc_id").alias("rep"), "x.sketch")
    classes = materialise(classes, "classes")
    banded = bands(classes)
    centres = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last").select("band", "centre")
    members = materialise(banded.join(centres.hint("merge"), "band"), "members")
    # of the smallest members of its bands, a class is compared with those that it meets most often
    pairs = members.where("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))).where(F.col("place") <= STARS).select("a", "b")
    tested = materialise(likely(pairs, classes, least), "pairs")
    links = materialise(confirm(tested, docs, words, least, id_col, text_col), "links")
    labels = materialise(components(links), "labels")
    # what the stars have left apart, across the components of each band
    own = members.select("band", "rep").join(labels.hint("merge"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    of_class = classes.select("rep", "n_shingles", "sketch")
    apart = materialise(mixed(own).join(of_class.hint("merge"), "rep"), "apart")
    kept = materialise(hopeful(apart, least), "hopeful")
    sets = materialise(full_sets(kept.select("rep").distinct(), docs, words, id_col, text_col), "sets")
    rows = mixed(apart.drop("major").join(kept.hint("merge"), ["band", "rep"], "left_semi")).join(sets.hint("merge"), "rep")
    found = materialise(forests(rows, least), "links")
    if not found.isEmpty():
        stars = labels.select(F.col("rep").alias("a"), F.col("component").alias("b"))
        labels = materialise(components(stars.union(found)), "labels")
    discard(members, tested, links, apart, kept, sets, found)
    whole = classes.select("h1", "h2", "n_shingles", "rep").join(labels.hint("merge"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = one.select("doc_id", "n_shingles", "h1", "h2").join(whole.hint("merge"), ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)

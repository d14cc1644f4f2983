"""A stored inverted index for the ranked search of ``search``: same specification, same rows, without reading all postings.

A folder holds, as Parquet:

    docs        the search documents with their number and the lengths of their fields
    blocks      token, field, range, n, most, entries (doc, part): the postings of a token in a field of a range, RANGE
                documents at most that a task reads one after the other; part is the field's score for the token in the
                document but for the token's rarity, so a query only weighs and adds; most is the greatest part.
                A task makes the blocks of its documents and sorts them by token, so nothing is shuffled and row groups
                are skipped by token.
    vocabulary  tokens in order, so a prefix is a run of them, with the number of documents that hold them in each field
    segments    token by the keys that its near spellings share

Search (block-max): the bound of a range is the sum of what its blocks can give at most; a range that lacks a query token
has no result. The ranges of the greatest bounds are scored first, until k documents are found: the k-th score is
then the least that counts, and only ranges whose bound reaches it are scored. No other document can be among the k.

Near spellings: tokens of length l are cut into d + 1 segments for every number d of edits that a query near that
length allows. d edits touch d segments at most, so a query within d edits holds one of the others as it stands,
moved by d places at most. A query asks for its few such keys and compares itself with what it finds, never with
the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search as S

#: Documents of a range; ranges that are scored at first, and how many times more each time they give too few results.
RANGE, FIRST, MORE = 1024, 4, 8
#: Expanded tokens that are handed to the scan as values; more are joined.
LITERAL = 200


edits_for = S.edits_for

#: A row of the blocks.
BLOCK = "token string, field int, range bigint, n int, most double, entries array<struct<doc: bigint, part: double>>"


def blocks_of(batches: Iterator[pa.RecordBatch], size: int, means: list[float]) -> Iterator[pa.RecordBatch]:
    """The blocks of documents with their fields' tokens; a range's number is that of its first document."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            piece = batch.slice(at, size)
            docs = piece.column("doc").to_numpy()
            for i, (name, mean) in enumerate(zip(S.FIELDS, means, strict=True)):
                tokens = piece.column(name)
                words = pc.dictionary_encode(tokens.flatten())
                if not len(words):
                    continue
                held = words.indices.to_numpy().astype(np.int64) * len(docs) + pc.list_parent_indices(tokens).to_numpy()
                pairs, tf = np.unique(held, return_counts=True)
                token, doc = np.divmod(pairs, len(docs))
                length = np.bincount(doc, minlength=len(docs))[doc]
                part = S.FIELDS[name] * (S.D + tf * (S.K + 1) / (tf + S.K * (1 - S.B + S.B * length / mean)))
                starts = np.flatnonzero(np.diff(token, prepend=-1))
                entries = pa.StructArray.from_arrays([pa.array(docs[doc]), pa.array(part)], ["doc", "part"])
                ends = np.append(starts, len(token))
                n = len(starts)
                columns = [words.dictionary.cast(pa.string()), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, docs[0])), pa.array(np.diff(ends).astype(np.int32)), pa.array(np.maximum.reduceat(part, starts)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "field", "range", "n", "most", "entries"])


def cut(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 segments of a token of this length, as equal as may be."""
    n, at, out = edits + 1, 0, []
    for i in range(n):
        size = length // n + (i >= n - length % n)
        out.append((at, size))
        at += size
    return out


def key(length: Column | int, edits: int, i: int, segment: Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.xxhash64(length.cast("int"), F.lit(edits), F.lit(i), segment)


def segment_keys(token: Column) -> Column:
    """The keys of a vocabulary token, for every number of edits by which a query may come near its length."""
    n, keys = F.length(token), []
    for edits in range(1, S.MOST_EDITS + 1):
        # queries that allow so many edits have lengths of a run; the last run has no end
        lengths = [q for q in range(1, 400) if edits_for(q) == edits]
        near = (n >= lengths[0] - edits) & (F.lit(True) if edits == S.MOST_EDITS else n <= lengths[-1] + edits)
        size, rest = F.floor(n / (edits + 1)).cast("int"), (n % (edits + 1)).cast("int")
        for i in range(edits + 1):
            longer = F.greatest(F.lit(0), F.lit(i) - (edits + 1 - rest))
            own = F.when(F.lit(i) >= edits + 1 - rest, size + 1).otherwise(size)
            keys.append(F.when(near, key(n, edits, i, F.substring(token, F.lit(i) * size + longer + 1, own))))
    return F.array_compact(F.array(*keys))


def query_keys(token: str) -> list[tuple[int, int, int, str]]:
    """(length, edits, segment's number, text) of the keys that a token within the edits must have one of."""
    edits, out = edits_for(len(token)), set()
    if edits:
        for length in range(max(0, len(token) - edits), len(token) + edits + 1):
            for i, (at, size) in enumerate(cut(length, edits)):
                for start in range(max(0, at - edits), min(len(token) - size, at + edits) + 1):
                    out.add((length, edits, i, token[start : start + size]))
    return sorted(out)


@dataclass
class Found:
    """A search's rows, and what it read: blocks and entries, of all that its tokens have."""

    rows: DataFrame
    read: dict[str, int]


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, docs: DataFrame, path: str, size: int = RANGE) -> TextIndex:
        """Of search documents (see ``search.search_docs``), each row a document with an id of its own."""
        own = cls(docs.sparkSession, path)
        put = lambda rows, name: rows.write.option("compression", "zstd").parquet(f"{own.path}/{name}")
        names, tokens = list(S.FIELDS), lambda f: S.tokenize(F.coalesce(F.col(f), F.lit("")))
        put(docs.withColumns({"doc": F.monotonically_increasing_id(), "lengths": F.array(*(F.size(F.array_distinct(tokens(f))) for f in names))}), "docs")
        docs, length = own.table("docs"), lambda i: F.col("lengths")[i]
        means = [m or 1.0 for m in docs.agg(*(F.avg(F.when(length(i) > 0, length(i))) for i in range(len(names)))).first()]
        blocks = docs.select("doc", *(tokens(f).alias(f) for f in names)).mapInArrow(partial(blocks_of, size=size, means=means), BLOCK)
        put(blocks.sortWithinPartitions("token", "range"), "blocks")
        n_of = [F.sum(F.when(F.col("field") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(names))]
        put(own.table("blocks").groupBy("token").agg(*n_of).repartitionByRange("token").sortWithinPartitions("token"), "vocabulary")
        words = own.table("vocabulary")
        put(words.select("token", F.explode(segment_keys(F.col("token"))).alias("key")).repartitionByRange("key", "token").sortWithinPartitions("key"), "segments")
        return own

    def near(self, token: str) -> DataFrame:
        """token of the vocabulary that shares a key with the query token; its distance isn't known yet."""
        asked = query_keys(token)
        if not asked:
            return self.table("vocabulary").select("token").where(F.lit(False))
        keys = self.spark.createDataFrame(asked, "l int, e int, i int, s string").select(F.xxhash64("l", "e", "i", "s").alias("key"))
        # a token of n characters has some (2 d + 1) (d + 1) (2 d + 1) keys at most, of at most 6 edits: 1,183
        return self.table("segments").join(F.broadcast(keys), "key", "left_semi").select("token").distinct()

    def expand(self, query: str, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
        """(q, token, weight): as ``search.expand``, by runs of the sorted vocabulary and keys of segments."""
        out = None
        for q, asked in enumerate(self.tokens(query)):
            words, L, n = self.table("vocabulary").select("token"), F.length("token"), len(asked)
            exact = words.where(F.col("token") == asked).select("token", F.lit(1.0).alias("weight"))
            parts = [exact]
            if prefix:
                parts.append(words.where(F.col("token").startswith(asked) & (F.col("token") != asked)).select("token", (S.PREFIX * L / (L + 0.3 * (L - n))).alias("weight")))
            if fuzzy:
                distance = F.levenshtein("token", F.lit(asked))
                close = self.near(asked).where((distance <= edits_for(n)) & (F.col("token") != asked))
                if prefix:
                    close = close.where(~F.col("token").startswith(asked))
                parts.append(close.select("token", (S.FUZZY * L / (L + distance)).alias("weight")))
            for p in parts:
                p = p.select(F.lit(q).alias("q"), "token", "weight")
                out = p if out is None else out.unionByName(p)
        return out

    def weighed(self, expanded: DataFrame, words: DataFrame) -> DataFrame:
        """(q, token, field, weight) of an expansion: weights with the token's rarity in each field that holds it."""
        docs = F.lit(self.table("docs").count())
        fields = [F.struct(F.lit(i).alias("field"), F.col(f"n{i}").alias("n")) for i in range(len(S.FIELDS))]
        rows = expanded.join(words, "token").select("q", "token", "weight", F.inline(F.array(*fields))).where("n > 0")
        return rows.select("q", "token", "field", (F.col("weight") * F.log(1 + (docs - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("weight"))

    def tokens(self, query: str) -> list[str]:
        return S.asked_of(self.spark, query)

    def search(self, query: str, k: int = 40, prefix: bool = True, fuzzy: bool = True) -> Found:
        """rank, id, score of the k best documents that match every token, ties at ``search.DIGITS`` decimals to the smaller id; an empty query finds nothing."""
        n = len(self.tokens(query))
        shape = "rank int, id string, score double"
        if not n:
            return Found(self.spark.createDataFrame([], shape), {"blocks": 0, "of_blocks": 0, "entries": 0, "of_entries": 0})
        expanded = self.expand(query, prefix, fuzzy)
        few = expanded.limit(LITERAL + 1).collect()
        blocks, words = self.table("blocks"), self.table("vocabulary")
        if len(few) <= LITERAL:  # known values reach the scan
            blocks, words = (t.where(F.col("token").isin([r.token for r in few])) for t in (blocks, words))
            few = self.weighed(F.broadcast(self.spark.createDataFrame(few, "q int, token string, weight double")), words).collect()
            expanded = F.broadcast(self.spark.createDataFrame(few, "q int, token string, field int, weight double"))
        else:
            expanded = self.weighed(expanded, words)
        weighed = blocks.drop("entries").join(expanded, ["token", "field"])
        bounds = weighed.groupBy("range", "q").agg(F.sum(F.col("weight") * F.col("most")).alias("most"), F.count("*").alias("blocks"), F.sum("n").alias("n"))
        bounds = bounds.groupBy("range").agg(F.sum("most").alias("most"), F.count("*").alias("matched"), F.sum("blocks").alias("blocks"), F.sum("n").alias("n"))
        bounds = bounds.withColumn("all", F.col("matched") == n).withColumn("bound", F.col("most") * n * (1 + 1e-9)).persist()
        total = bounds.agg(F.sum("blocks"), F.sum("n"), F.count_if("all")).first()
        # a sum depends in its last bits on the order of its parts, so bounds give way by more than that
        size, floor = FIRST, 0.0
        while size < (total[2] or 0):
            head = bounds.where("all").orderBy(F.desc("bound"), "range").limit(size)
            tried = self.scores(blocks, expanded, head, n).orderBy(F.desc("score")).limit(k).collect()
            if len(tried) == k:
                floor = tried[-1].score - S.SLACK
                break
            size *= MORE
        wanted = bounds.where("all").where(F.col("bound") >= floor)
        read = wanted.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        scored = self.scores(blocks, expanded, wanted, n).where(F.col("score") >= floor).persist()
        # of the documents that reach the k-th score, ties included, the names decide
        least = scored.orderBy(F.desc("score")).limit(k).agg(F.min("score") - S.SLACK).first()[0]
        best = scored.where(F.col("score") >= F.lit(least)).withColumn("score", F.round("score", S.DIGITS)).join(self.table("docs").select("doc", "id").hint("merge"), "doc")
        best = best.select("id", "score").orderBy(F.desc("score"), "id").limit(k).collect()
        scored.unpersist()
        bounds.unpersist()
        rows = self.spark.createDataFrame([(i + 1, *b) for i, b in enumerate(best)], shape)
        return Found(rows, {"blocks": read[0], "of_blocks": total[0] or 0, "entries": read[1], "of_entries": total[1] or 0})

    @staticmethod
    def scores(blocks: DataFrame, expanded: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
        """doc, score of the documents of the ranges that match all n tokens."""
        rows = blocks.join(ranges.select("range"), "range", "left_semi").join(expanded, ["token", "field"]).select("q", "weight", F.explode("entries").alias("e"))
        each = rows.groupBy(F.col("e.doc").alias("doc")).agg(F.sum(F.col("weight") * F.col("e.part")).alias("total"), F.count_distinct("q").alias("matched"))
        return each.where(F.col("matched") == n).select("doc", (F.col("total") * n).alias("score"))

    def hits(self, query: str, k: int = 40, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
        """rank, id, title, badge, url, score, snippet: what a page shows; the k rows meet the documents."""
        best = self.search(query, k, prefix, fuzzy).rows
        badge = F.when(F.col("kind") == "term", "Dictionary").otherwise(F.col("collection"))
        return self.table("docs").join(F.broadcast(best), "id").select("rank", "id", "title", badge.alias("badge"), "url", "score", T.snippet(F.col("text"), F.lit(query)).alias("snippet"))

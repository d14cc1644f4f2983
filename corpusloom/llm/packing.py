"""Best-fit packing of tokenised documents into training sequences under several capacities at once.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are placed in order of falling length; of the open sequences that hold a piece
under every constraint, the one with the least weighted residual norm (or the largest weighted dot
product) gets it. Documents over the token capacity are cut, no others.

At scale: tokenising is one narrow pass; what is shuffled is a few numbers a piece. Pieces are dealt
by a hash of their place in the table of pieces, whatever their source or id, into groups of about
GROUP; a group leaves a few sequences short, so the loss against one global packing is a few
sequences per GROUP pieces. Under the capacities below only the tokens bind, as every piece has a
token at least: documents and cost are slack, so that sequences are as few as possible.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import portions
from corpusloom.llm.common import materialise, table

#: Capacities of a sequence.
MAX_TOKENS, MAX_DOCS, MAX_COST = 2048, 2048, 2048 * 2048
#: Weights of the three in the norm and the dot product.
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces that one task packs.
GROUP = 8192
#: Words that a worker remembers; when full, it starts anew.
CACHE_WORDS = 1_200_000
#: The id that ends each document.
END_ID = 0

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class WordTokenizer:
    """Ids of texts by a tokenizers file whose pieces never cross a space, so that what spaces set apart is encoded once.

    Strings of its special tokens get their ids, as they do in the library by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = self.words
        units = [text.split(" ") for text in texts]
        missing = set().union(*units).difference(words)
        if len(words) + len(missing) > CACHE_WORDS:
            words.clear()
            missing = set().union(*units)
        order = list(missing)
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            for w, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = array("I", x.ids)
                if sys.byteorder != "little":
                    ids.byteswap()
                words[w] = ids.tobytes()
        out = [b"".join(map(words.__getitem__, u)) for u in units]
        for w in order:
            if len(w) > 64:
                del words[w]
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One a worker process, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of each document: its ids end with END_ID; only longer documents have several.

    A null text counts as empty: one piece that holds END_ID alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            packed = (x for texts in portions(batch.column(1)) for x in coder.encode_many(texts))
            for doc_id, ids in zip(batch.column(0).to_pylist(), packed, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, weights: tuple = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, given in order of falling length. rule: norm or dot.

    A piece that alone exceeds a capacity gets a sequence of its own.
    """
    n = len(lengths)
    which, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.array([max_tokens, max_docs, max_cost], np.int64)
    scale = np.asarray(weights) ** 0.5 / full
    room = np.zeros((max(n, 1), 3), np.int64)  # residual capacities of the open sequences
    name = np.zeros(max(n, 1), np.int64)
    opened = live = 0
    least = int(lengths.min()) if n else 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], np.int64)
        fits = np.flatnonzero((room[:live] >= need).all(1)) if live else ()
        if len(fits):
            after = (room[fits] - need) * scale
            if rule == "dot":
                at = fits[int(np.argmax((room[fits] * scale) @ (need * scale)))]
            else:
                at = fits[int(np.argmin((after * after).sum(1)))]
        else:
            at, live = live, live + 1
            room[at], name[at] = full, opened
            opened += 1
        which[i], offset[i] = name[at], max_tokens - room[at, 0]
        room[at] -= need
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < least * least:  # nothing more fits: the last open one takes its place
            live -= 1
            room[at], name[at] = room[live], name[live]
    return which, offset


def pack(found: DataFrame, n_pieces: int, **limits) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(); n_pieces: how many there are."""
    groups = max(1, -(-n_pieces // GROUP))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        which, offset = best_fit(rows["length"].to_numpy().astype(np.int64), **limits)
        which += key[0].as_py() << 32
        columns = [rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(which), pa.array(offset)]
        return pa.Table.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # by the row's place, as one id may be that of many rows; the rows are those of a written table
    dealt = found.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("bigint"))
    return dealt.groupBy("part").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Equal rows are packed each; an empty table gives an empty result; columns other than the two
    named are not read.
    """
    found = materialise(pieces(docs, path, max_tokens, id_col, text_col), "pieces")
    return pack(found, found.count(), max_tokens=max_tokens, **limits)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())

"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of n bytes starts as n tokens. Leaf i of the tree holds the rank of the pair that starts at
live position i, packed with i, so that the root is the leftmost pair of the lowest rank. A merge
kills one position and changes three leaves at most, each in O(log n): O(n log n) for a piece of any
length, where rescanning all pairs would take O(n^2).

Work is per row: no shuffle, one pass, memory bounded by a batch and the piece cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Pieces that a worker remembers; when full, it starts anew.
CACHE_PIECES = 600_000
#: Longer pieces are merged one by one and not remembered.
CACHE_BYTES = 64
#: Trees that are built at a time, and characters of text that are encoded at a time.
ROWS, CHARS = 16_384, 2_000_000
NONE = np.int64(1 << 62)

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class SegmentTreeBPE:
    """Encoder and decoder for the ranks of a .tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.vocabulary[i] = token
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        size = 1 << (n - 1).bit_length()
        none = int(NONE)
        tree = [none] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        #: end[i]: where the token at live position i ends, so where the next one starts; before[i]: start of the one before
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        while (top := tree[1]) != none:
            i = top & 0xFFFFFFFF
            j = end[i]
            k = end[j]
            end[i] = k
            if k < n:
                before[k] = i
            self._put(tree, size + j, none)
            rank = get(piece[i : end[k]]) if k < n else None
            self._put(tree, size + i, none if rank is None else rank << 32 | i)
            if (h := before[i]) >= 0:
                rank = get(piece[h:k])
                self._put(tree, size + h, none if rank is None else rank << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    @staticmethod
    def _put(tree: list[int], k: int, value: int) -> None:
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces; short ones are merged many at a time."""
        out: dict[str, bytes] = {}
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            elif len(raw) > CACHE_BYTES:
                out[p] = np.array(self.merge(raw), "<u4").tobytes()
            else:
                rows.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((p, raw))
        for size, found in rows.items():
            for at in range(0, len(found), ROWS):
                block = found[at : at + ROWS]
                out |= zip([p for p, _ in block], self.merge_rows([raw for _, raw in block], size), strict=True)
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where their bytes joined are no token."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NONE)

    def index_pairs(self) -> None:
        ranks, pairs = self.ranks, []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, i))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_values = np.array([i for _, i in pairs] or [0], np.int64)
        self.byte_ids = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        self.byte_pairs = np.array([[ranks.get(bytes([i, j]), NONE) for j in range(256)] for i in range(256)], np.int64)

    def merge_rows(self, raws: list[bytes], size: int) -> list[bytes]:
        """merge() for pieces of at most ``size`` bytes, a tree per row; each round merges once in every row that still can."""
        if not hasattr(self, "pair_keys"):
            self.index_pairs()
        count = len(raws)
        lengths = np.fromiter(map(len, raws), np.int64, count)
        bytes_ = np.frombuffer(b"".join(raw.ljust(size, b"\0") for raw in raws), np.uint8).reshape(count, size)
        ids = np.concatenate([self.byte_ids[bytes_], np.zeros((count, 1), np.int64)], 1)
        places = np.arange(size)
        alive = places < lengths[:, None]
        after = np.tile(np.arange(1, size + 2), (count, 1))  # after[i]: the live position that follows i
        before = np.tile(np.arange(-1, size), (count, 1))
        tree = np.full((count, 2 * size), NONE)
        leaf = self.byte_pairs[bytes_[:, :-1], bytes_[:, 1:]]
        leaf = np.where((leaf != NONE) & alive[:, 1:], leaf << 32 | places[:-1], NONE)
        tree[:, size : 2 * size - 1] = leaf
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & 0xFFFFFFFF
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = top >> 32
            alive[rows, j] = False
            after[rows, i] = k
            before[rows, np.minimum(k, size)] = i
            h = before[rows, i]
            last, first = k >= lengths[rows], h < 0
            rank = np.where(last, NONE, self.pair_ranks(ids[rows, i], ids[rows, np.minimum(k, size)]))
            tree[rows, size + j] = NONE
            tree[rows, size + i] = np.where(rank == NONE, NONE, rank << 32 | i)
            h = np.where(first, i, h)  # nothing stands before the first: its own leaf again
            rank = np.where(first, rank, self.pair_ranks(ids[rows, h], ids[rows, i]))
            tree[rows, size + h] = np.where(rank == NONE, NONE, rank << 32 | h)
            nodes = np.stack([size + i, size + j, size + h]) >> 1
            while nodes[0, 0]:
                for node in nodes:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                nodes >>= 1
            rows = rows[tree[rows, 1] != NONE]
        ends = (4 * alive.sum(1).cumsum()).tolist()
        packed = ids[:, :size][alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """encode_many() by the pattern's pieces."""
        cache = self.cache
        found = list(map(self.pieces, texts))
        missing = set().union(*found).difference(cache)
        if missing:
            if len(cache) + len(missing) > CACHE_PIECES:
                cache.clear()
                missing = set().union(*found)
            learnt = self.learn(missing)
            cache.update(learnt)
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in found]
        if missing:
            for p in learnt:
                if len(p) > CACHE_BYTES:
                    del cache[p]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A lone space between two characters that aren't white space always begins a piece, so what
        such spaces set apart can be encoded, and remembered, by itself. Texts with other runs of
        white space round a space go by their pieces.
        """
        words = self.words
        units = [text.split(" ") for text in texts]
        missing = set()
        for u in units:
            missing.update(u[1:])
        missing.difference_update(words)
        plain = [w for w in missing if w and not w[0].isspace() and not w[-1].isspace()]
        if len(words) + len(plain) > CACHE_PIECES:
            words.clear()
            plain = [w for w in set().union(*(u[1:] for u in units)) if w and not w[0].isspace() and not w[-1].isspace()]
        words.update(zip(plain, self.encode_pieces([f" {w}" for w in plain]), strict=True))
        first = [u[0] if not u[0] or not u[0][-1].isspace() else None for u in units]
        heads = dict(zip(first, self.encode_pieces([w or "" for w in first]), strict=True))
        out: list[bytes | None] = []
        for u, w in zip(units, first, strict=True):
            try:
                out.append(heads[w] + b"".join([words[x] for x in u[1:]]) if w or w is not None and len(u) == 1 else None)
            except KeyError:
                out.append(None)
        odd = [i for i, x in enumerate(out) if x is None]
        for i, packed in zip(odd, self.encode_pieces([texts[i] for i in odd]), strict=True):
            out[i] = packed
        for w in plain:
            if len(w) > CACHE_BYTES:
                del words[w]
        return out

    def encode_packed(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> SegmentTreeBPE:
    """One a worker process, kept between its tasks."""
    return SegmentTreeBPE(load_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, null as empty, about CHARS characters at a time."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the packed ids and of the bytes decoded from them; with keep_ids also ids.

    A null text counts as empty: no tokens, the digests of no bytes. Rows that repeat give rows that
    repeat; an empty table gives an empty one. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            n, ids_of, coded, decoded = [], [], [], []
            for texts in portions(batch.column(1)):
                for packed in bpe.encode_many(texts):
                    ids = np.frombuffer(packed, "<u4")
                    n.append(len(ids))
                    coded.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest())
                    if keep_ids:
                        ids_of.append(ids.astype("i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *default_vocabulary())

"""Media columns: payloads stored as WAV files that are cut by content, deduplicated by chunk and verified when read.

A payload is stored as an 8-bit mono WAV file, one sample a byte. The file is cut after its header
and then wherever a rolling gear hash of the last 32 bytes has its high bits at zero, so equal
passages give equal chunks wherever they stand. Chunks go to pack files in the shared folder, many to
a compressed block. Spark joins on the chunks' digests make every list of chunks point to one copy of
each; a file is rebuilt from its ordered list by range reads, each chunk checked by its digest.

At scale: payload bytes are never shuffled, only (digest, place) rows of some tens of bytes a chunk.
Digests are aggregated before they are shuffled, and only those with several places are joined back,
by a sort-merge join whose hot keys Spark splits. A chunk that two tasks meet is written by both; the
one that no list points to is garbage that a rewrite of the pack would drop.

A pack has a name of its own for each attempt of a task, and only packs named by the rows of the
attempts that Spark committed are read: a lost executor costs a repeat and an unread file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import filesystem, make_folder, materialise, shared_folder, table

#: Least, mean (above the least) and greatest size of a chunk in bytes; the mean is a power of 2.
LEAST, MEAN, MOST = 512, 2048, 16_384
#: Bytes of chunks in a compressed block, and blocks that a reading task holds.
BLOCK, HELD_BLOCKS = 1 << 18, 48
RATE = 16_000
#: A payload is padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 192, b" "

PLACE = "struct<pack:string,block:bigint,packed:int,at:int,size:int>"
LISTS = f"doc_id bigint, n_bytes bigint, pack string, row bigint, chunks array<struct<digest:binary,place:{PLACE}>>"
RESULT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int"


def gear_table() -> np.ndarray:
    """256 words by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload, its length the last."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # h[i] = sum of gear[byte i - j] << j over the last 2 * shift bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    out, at = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1).tolist():
        while end - at > MOST:
            at += MOST
            out.append(at)
        if end - at >= LEAST:
            out.append(end)
            at = end
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n] if at < n else out


def pad(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), PAD)


def wav_header(n: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wav_samples(media: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def feature(samples: bytes) -> str:
    """Mean, root mean square, zero crossings a sample and peak of the samples about their middle, 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zcr={np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)) / max(1, len(x) - 1):.6f};peak={np.abs(x).max():.0f}"


class PackWriter:
    """Chunks of one attempt of a task: each once, in compressed blocks of one file that exists once there is a chunk."""

    def __init__(self, folder: str):
        import zstandard

        self.folder, self.name = folder, f"{uuid.uuid4().hex}.pack"
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.file, self.offset = None, 0
        self.open: list[bytes] = []
        self.size = 0
        #: digest: [block, packed size, place in the block, size]; the first two once its block is written
        self.places: dict[bytes, list[int]] = {}
        self.waiting: list[list[int]] = []

    def put(self, chunk: bytes) -> tuple[bytes, list[int]]:
        digest = hashlib.sha256(chunk).digest()
        place = self.places.get(digest)
        if place is None:
            self.places[digest] = place = [0, 0, self.size, len(chunk)]
            self.waiting.append(place)
            self.open.append(chunk)
            self.size += len(chunk)
        return digest, place

    def flush(self) -> None:
        if not self.waiting:
            return
        if self.file is None:
            files, path = filesystem(f"{self.folder}/{self.name}")
            self.file = files.open_output_stream(path)
        packed = self.compress(b"".join(self.open))
        self.file.write(packed)
        for place in self.waiting:
            place[0], place[1] = self.offset, len(packed)
        self.offset += len(packed)
        self.open, self.waiting, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        if self.file is not None:
            self.file.close()


class PackReader:
    def __init__(self, folder: str):
        import zstandard

        self.folder, self.expand = folder, zstandard.ZstdDecompressor().decompress
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], bytes] = OrderedDict()

    def chunk(self, place: dict) -> bytes:
        key = place["pack"], place["block"]
        block = self.blocks.get(key)
        if block is None:
            file = self.files.get(key[0])
            if file is None:
                files, path = filesystem(f"{self.folder}/{key[0]}")
                file = self.files[key[0]] = files.open_input_file(path)
                if len(self.files) > 32:
                    self.files.popitem(last=False)[1].close()
            block = self.blocks[key] = self.expand(file.read_at(place["packed"], key[1]))
            if len(self.blocks) > HELD_BLOCKS:
                self.blocks.popitem(last=False)
        else:
            self.blocks.move_to_end(key)
        return block[place["at"] : place["at"] + place["size"]]


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the packs and returns a row per document with its ordered chunk list, committed to the shared folder."""
    make_folder(folder)
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("place", pa.struct([("pack", pa.string()), ("block", pa.int64()), ("packed", pa.int32()), ("at", pa.int32()), ("size", pa.int32())]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, row = PackWriter(folder), 0
        try:
            for batch in batches:
                ids, sizes, lists = batch.column(0), [], []
                for text in batch.column(1):
                    data = (text.as_py() or "").encode("utf-8")
                    payload = pad(data)
                    ends = cuts(payload)
                    lists.append([writer.put(wav_header(len(payload))), *(writer.put(payload[a:b]) for a, b in zip([0, *ends], ends))])
                    sizes.append(len(data))
                    if writer.size >= BLOCK:
                        writer.flush()
                writer.flush()
                chunks = [[{"digest": d, "place": {"pack": writer.name, "block": p[0], "packed": p[1], "at": p[2], "size": p[3]}} for d, p in found] for found in lists]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([writer.name] * len(sizes), pa.string()), pa.array(range(row, row + len(sizes)), pa.int64()), pa.array(chunks, kind)], names=["doc_id", "n_bytes", "pack", "row", "chunks"])
                row += len(sizes)
        finally:
            writer.close()

    return materialise(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, LISTS), "chunk-lists")


def deduplicate(lists: DataFrame) -> DataFrame:
    """The rows of store(), every chunk at its digest's one place: the least of those where it was written."""
    refs = lists.select("doc_id", "n_bytes", "pack", "row", F.posexplode("chunks").alias("k", "c")).select("doc_id", "n_bytes", "pack", "row", "k", "c.digest", "c.place")
    places = refs.groupBy("digest").agg(F.min("place").alias("one"), F.max("place").alias("last"))
    several = places.where("one <> last").select("digest", "one")
    joined = refs.join(several, "digest", "left").select("doc_id", "n_bytes", "pack", "row", F.struct("k", "digest", F.coalesce("one", "place").alias("place")).alias("c"))
    # by range, and again by the same key: the rows of a pack stay together, so that its blocks are read once
    # in a fixed number of parts, as Spark would merge them by the bytes of references and not of what they name
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = joined.repartitionByRange(n, "pack", "row")
    return ranged.groupBy("pack", "row", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list("c")).alias("chunks")).sortWithinPartitions("pack", "row")


def read_back(lists: DataFrame, folder: str) -> DataFrame:
    """Rebuilds every stored file from its chunks and computes what RESULT names from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader(folder)
        for batch in batches:
            rows = []
            for doc_id, n_bytes, chunks in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("chunks"), strict=True):
                parts, chunks = [], chunks.as_py()
                for c in chunks:
                    part = reader.chunk(c["place"])
                    if hashlib.sha256(part).digest() != c["digest"]:
                        raise ValueError(f"a chunk at {c['place']} differs from its digest")
                    parts.append(part)
                media = b"".join(parts)
                samples = wav_samples(media)
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), len(chunks)))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])

    return lists.select("doc_id", "n_bytes", "chunks").mapInArrow(run, RESULT)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT per document. A null text counts as empty; equal rows are stored and read each; an empty table gives no rows."""
    folder = shared_folder(docs.sparkSession, "packs")
    return read_back(deduplicate(store(docs, folder, id_col, text_col)), folder)


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))



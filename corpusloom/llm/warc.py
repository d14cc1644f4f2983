"""WARC archives and a two-level capture index over them.

Pages are dealt by range of (reversed-host URL key, page id). Each task writes one archive of gzipped
records and one index file: capture lines in key order, BLOCK_LINES to a compressed block, and at its
end the sparse directory of those blocks. Above stands the list of index files by their first key.
A look-up binary-searches that list, then the file's directory, then reads and binary-searches one
block, and reads one record by its range.

At scale: each payload is shuffled once. Digests are aggregated before they are shuffled, and rows
without payloads are joined with the repeated ones, by a sort-merge join whose hot keys Spark splits;
the revisits then meet their pages by range, so that neither one host nor one payload fills a task.
Only the list of index files comes to the driver: a row per archive, of which there are at most
MAX_ARCHIVES whatever the input.

Files have a name of their own for each attempt of a task; only those that committed attempts name are read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import filesystem, make_folder, materialise, shared_folder, table

#: Smaller payloads are never revisits.
LEAST_REVISIT = 100
#: Capture lines in a block of the index; archives at most.
BLOCK_LINES, MAX_ARCHIVES = 500, 20_000
#: Date of all records; a crawl would give its own.
DATE = "2024-01-01T00:00:00Z"

NO_ID = -(1 << 63)
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: Column) -> Column:
    """Reversed host, then port, path and query: http://b.example.com/x gives com,example,b)/x. Null gives ')'."""
    url = F.coalesce(url, F.lit(""))
    front = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"
    host = F.lower(F.regexp_extract(url, front, 1))
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(url, front, "")), r"[\s\x00-\x20]", "%20")


def record(page_id: int, url: str, html: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, compressed; with refers_to a revisit, which has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields before the first blank line, in lower case, and what follows it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}, rest


def parse_record(raw: bytes) -> tuple[int, str, str, int | None, int, bytes]:
    """page id, kind, digest, refers_to, size of the full payload, payload of a compressed record."""
    head, rest = headers(zlib.decompress(raw, 31))
    http, payload = headers(rest[: int(head["content-length"])])
    number = lambda s: int(s.removeprefix("<urn:page:").removesuffix(">"))
    kind, size = head["warc-type"], int(http["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
    return number(head["warc-record-id"]), kind, digest, number(head["warc-refers-to"]) if "warc-refers-to" in head else None, size, payload


class IndexWriter:
    """Capture lines in key order to a file of compressed blocks that ends with their directory."""

    def __init__(self, stream):
        self.stream, self.at, self.lines, self.directory = stream, 0, [], []

    def put(self, key: str, page_id: int, archive: str, at: int, size: int) -> None:
        self.lines.append([key, page_id, archive, at, size])
        if len(self.lines) >= BLOCK_LINES:
            self.flush()

    def _write(self, value) -> int:
        self.stream.write(packed := zlib.compress(json.dumps(value, separators=(",", ":")).encode(), 6))
        self.at += len(packed)
        return len(packed)

    def flush(self) -> None:
        if self.lines:
            at = self.at
            self.directory.append([*self.lines[0][:2], at, self._write(self.lines)])
            self.lines = []

    def close(self) -> None:
        self.flush()
        self.stream.write(struct.pack("<QQ", self.at, self._write(self.directory)))
        self.stream.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[tuple[str, int, str]]:
    """Writes archives and indexes; (first key, its page id, index file) of each, in order.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those of the smallest page id become
    responses and the others revisits. A null page counts as empty; rows without an id stay responses.
    """
    spark = pages.sparkSession
    make_folder(folder)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    base = base.select("*", url_key(F.col("url")).alias("key"), F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    large = base.where(F.col("size") >= LEAST_REVISIT).select("key", "page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    revisits = large.join(first, "digest").where("page_id > first").select("key", "page_id", F.lit(0).alias("kind"), F.col("first").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(None).cast("bigint").alias("size"))
    rows = base.select("key", "page_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("refers_to"), "url", "html", "digest", "size")
    n = min(MAX_ARCHIVES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = revisits.unionByName(rows).repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "digest", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened, at, revisit, top = uuid.uuid4().hex, None, 0, None, None
        for batch in batches:
            for key, page_id, kind, refers_to, url, html, digest, size in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "kind", "refers_to", "url", "html", "digest", "size")), strict=True):
                if kind == 0:
                    revisit = key, page_id, digest, refers_to
                    continue
                if opened is None:
                    files, path = filesystem(f"{folder}/{name}")
                    opened, index = files.open_output_stream(f"{path}.warc.gz", compression=None), IndexWriter(files.open_output_stream(f"{path}.index", compression=None))
                number = NO_ID if page_id is None else page_id
                top = top or (key, number)
                packed = record(number, url, html.encode(), size, digest, revisit[3] if revisit and revisit[:3] == (key, page_id, digest) else None)
                opened.write(packed)
                index.put(key, number, f"{name}.warc.gz", at, len(packed))
                at += len(packed)
        if opened is not None:
            opened.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"key": [top[0]], "page_id": [top[1]], "index": [f"{name}.index"]})

    done = materialise(dealt.mapInArrow(run, "key string, page_id bigint, index string"), "archives")
    return sorted((r["key"], r["page_id"], r["index"]) for r in done.collect())  # MAX_ARCHIVES rows at most


class CaptureReader:
    """Looks captures up and reads their records; what it opened last stays at hand."""

    def __init__(self, folder: str, top: list[tuple[str, int, str]]):
        self.folder, self.top, self.keys = folder, top, [t[:2] for t in top]
        self.held: OrderedDict[tuple, object] = OrderedDict()

    def _once(self, key: tuple, make):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            if len(self.held) > 64:
                old = self.held.popitem(last=False)[1]
                if isinstance(old, pa.NativeFile):
                    old.close()
        return self.held[key]

    def _file(self, name: str) -> pa.NativeFile:
        def make():
            files, path = filesystem(f"{self.folder}/{name}")
            return files.open_input_file(path)

        return self._once((name,), make)

    def _json(self, name: str, at: int, size: int):
        return self._once((name, at), lambda: json.loads(zlib.decompress(self._file(name).read_at(size, at))))

    def _directory(self, name: str):
        def make():
            file = self._file(name)
            at, size = struct.unpack("<QQ", file.read_at(16, file.size() - 16))
            found = json.loads(zlib.decompress(file.read_at(size, at)))
            return [tuple(x[:2]) for x in found], found

        return self._once((name, "directory"), make)

    def captures(self, key: str, page_id: int) -> Iterator[list]:
        """Capture lines of the key, also where they run over several blocks or files."""
        want = key, page_id
        i = max(0, bisect.bisect_left(self.keys, want) - 1)
        while i < len(self.top) and self.keys[i] <= want:
            starts, blocks = self._directory(self.top[i][2])
            j = max(0, bisect.bisect_left(starts, want) - 1)
            while j < len(blocks) and starts[j] <= want:
                lines = self._json(self.top[i][2], *blocks[j][2:])
                k = bisect.bisect_left(lines, want, key=lambda x: (x[0], x[1]))
                while k < len(lines) and (lines[k][0], lines[k][1]) == want:
                    yield lines[k]
                    k += 1
                j += 1
            i += 1

    def read(self, line: list) -> bytes:
        return self._file(line[2]).read_at(line[4], line[3])


def look_up(wanted: DataFrame, folder: str, top: list[tuple[str, int, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """RESULT of every capture of the wanted (URL, page id), by binary search and range reads; equal rows ask once."""
    asked = wanted.select(url_key(F.col(url_col).cast("string")).alias("key"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID).cast("bigint")).alias("page_id"))
    # by range, so that a task's look-ups share blocks; dropping duplicates needs no further exchange
    # in as many parts as the archives are written by, as a look-up's work is that of its page and not of its key
    n = min(MAX_ARCHIVES, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.repartitionByRange(n, "key", "page_id").dropDuplicates(["key", "page_id"]).sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CaptureReader(folder, top)
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                for line in reader.captures(key, page_id):
                    number, kind, digest, refers_to, size, _ = parse_record(reader.read(line))
                    rows.append((None if number == NO_ID else number, size, digest, kind, refers_to))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return asked.mapInArrow(run, RESULT)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    return look_up(pages, folder, write_archives(pages, folder))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number u in (0, 1) for every key, 52 bits of the MD5 of "key:shard", and the record goes
to the shard of the least -ln(u) / weight; of equal values to the smaller number. So shard i holds its share
weight_i / sum of the weights, and a shard that is added or grows takes records only into itself: no draw of
another shard changes. Only DataFrame functions.

At scale: a record's shard needs no other row. Places in a shard come from ``numbered``: rows are dealt by
ranges of (shard, key, row), so neither a shard nor a key that a third of the rows share is ever one task; no
text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import numbered, shared_folder, table

#: Shards of the registered query; bits of a draw; bytes of text that a written file holds, about.
SHARDS, BITS, FILE = 24, 52, 256 << 20


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """What the shard bids for the key; the least bid wins."""
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, BITS // 4), 16, 10).cast("double")
    return -F.log((draw + 0.5) / F.lit(2.0**BITS)) / weight


def bids(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """The least (cost, shard) over the shards first, first + 1, ...; a null key bids as the word null."""
    if not weights or not all(0 < w < float("inf") for w in weights):
        raise ValueError("every shard needs a positive, finite weight")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    shards = F.array(*(F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)))
    return F.array_min(F.transform(shards, lambda s: F.struct(cost(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard"))))


def assign(docs: DataFrame, weights: Sequence[float], grown: float = 1.0, id_col: str = "doc_id", names: tuple[str, str] = ("shard", "grown_shard")) -> DataFrame:
    """The rows with their shard and, in the second column, their shard once one of weight ``grown`` is added."""
    own, new = "corpusloom_bid", "corpusloom_new"
    rows = docs.withColumn(own, bids(F.col(id_col), weights)).withColumn(new, bids(F.col(id_col), [grown], len(weights)))
    return rows.withColumn(names[0], F.col(own)["shard"]).withColumn(names[1], F.least(own, new)["shard"]).drop(own, new)


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots follow doc_id (null first), size and checksum; rows that are equal in these take the next slots in
    any order. A null text has size 8 and checksum 0; a null id is a key of its own; rows of one id share
    their shard; texts may be of any length; an empty table gives no rows; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(8).cast("bigint")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(assign(rows, weights, grown, "doc_id"), ["shard"], ["doc_id", "size", "text_crc32"], "slot", few=True)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> str:
    """Writes the rows as Parquet under folder/shard=i, files of about FILE bytes of text each; the folder's address. A column ``shard`` of the rows' own is replaced."""
    folder = folder or shared_folder(docs.sparkSession, "shards")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    each = max(1, -(-size // (FILE * len(weights))))
    rows = assign(docs.drop("shard"), weights, id_col=id_col, names=("shard", "corpusloom_grown")).drop("corpusloom_grown")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(each))
    rows.withColumn("corpusloom_salt", salt).repartition(each * len(weights), "shard", "corpusloom_salt").drop("corpusloom_salt").write.partitionBy("shard").parquet(folder)
    return folder


def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM d, crc),
k AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM d),
b AS (
  SELECT doc_id, n AS shard, -ln((CAST('0x' || substr(md5(key || ':' || n), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS cost
  FROM k, range({SHARDS + 1}) r(n)),
c AS (SELECT doc_id, arg_min(shard, cost) FILTER (shard < {SHARDS}) AS shard, arg_min(shard, cost) AS grown FROM b GROUP BY doc_id)
SELECT s.doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM s JOIN c ON s.doc_id IS NOT DISTINCT FROM c.doc_id
"""

"""Prefix trie of conversations by partition refinement.

All distinct sequences of turns start in one class, the root. For each depth in turn, the active sequences meet
their turn at that depth and their class splits by it: a new class is a node, named by its smallest member. A class
of one sequence is retired; its tail is a chain of nodes without branches, emitted at once. What remains active
goes on to the next depth, so there are as many rounds as the longest prefix that two different sequences share.
Leaves and savings are then folded back from the deepest class to the root.

Equal conversations are one sequence with a weight: equal by their number of turns and 128 bits over all (depth,
SHA-256 of role and text). At scale: turns are numbered by ranges (``numbered``), so a conversation of a third of
all turns is spread over many parts; a round reads the turns of its depth only; classes are counted within tasks
before they are shuffled, and the joins that bring a class to its members are merge joins, whose hot classes
Spark's adaptive execution splits. Texts are never shuffled, only their digests. The digest of a node's ending
members is taken over chunks of their ids that are put together before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialise, numbered, table

#: Bytes of ids in a chunk, and turns of a block whose savings are summed before blocks are.
CHUNK, RUN = 1 << 16, 4096
#: Numbers that share a head, and most turns of a head plus one, in the rebuilt conversations.
FAMILY, HEADS = 100, 6
NONE = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, digest, points, number (from 0) of every turn.

    Turns follow turn_col (null first), then role and the digest of role and text. Null roles and texts are
    empty. Rows without a conversation's id belong to none and take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("bigint").alias("points"))
    return numbered(rows, ["conv_id"], ["turn", "role", "digest"], "number").select("conv_id", "digest", "points", "number")


def head_of(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the head of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations' ids, and conv_id, depth (from 1), digest, points of the turns of the rebuilt ones."""
    ids = turns.select("conv_id").distinct()
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), head_of(F.col("conv_id")).alias("head")).where("head > 0")
    # at most HEADS - 1 turns of a family's first conversation, for at most 2 * FAMILY of its numbers
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("number") < HEADS - 1)).select(F.col("conv_id").alias("family"), "digest", "points", "number")
    heads = materialise(wanted.join(first.hint("merge"), "family").where("number < head").select("conv_id", (F.col("number") + 1).alias("depth"), "digest", "points"), "heads")
    got = heads.groupBy("conv_id").agg(F.count("*").alias("got"))
    own = turns.withColumn("head", head_of(F.col("conv_id"))).where("number >= head").join(got.hint("merge"), "conv_id", "left")
    own = own.select("conv_id", (F.col("number") - F.col("head") + F.coalesce("got", F.lit(0)) + 1).alias("depth"), "digest", "points")
    return ids, heads.unionByName(own)


def digests_of_ends(members: DataFrame) -> DataFrame:
    """rep, ends: SHA-256 of the group's conv_ids, ascending, comma-joined. A group's ids pass one task as chunks of text, one at a time."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, first, parts, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(parts)], pa.string())], names=["rep", "first", "part"])

        for batch in batches:
            for group, conv in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if parts and (group != rep or size >= CHUNK):
                    yield out()
                    parts, size = [], 0
                if not parts:
                    rep, first = group, conv
                parts.append(str(conv))
                size += len(parts[-1]) + 1
        if parts:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, hashlib.sha256()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends"])

        for batch in batches:
            for group, part in zip(batch.column("rep").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if group != rep:
                    if rep is not None:
                        yield out()
                    rep, state = group, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
        if rep is not None:
            yield out()

    parts = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(chunks, "rep bigint, first bigint, part string")
    return parts.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digest, "rep bigint, ends string")


def distinct_sequences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """rep (the smallest id), length, weight and ends of every distinct sequence, the one without turns included."""
    place = F.struct("depth", "digest")
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("length"), F.bit_xor(F.xxhash64(F.lit(1), place)).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), place)).alias("b"))
    sums = materialise(ids.join(sums.hint("merge"), "conv_id", "left").na.fill(0), "sums")
    groups = materialise(sums.groupBy("length", "a", "b").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "groups")
    copies = sums.join(groups.where("weight > 1").hint("merge"), ["length", "a", "b"]).select("rep", "conv_id")
    several = groups.where("weight > 1").join(digests_of_ends(copies).hint("merge"), "rep").select("rep", "length", "weight", "ends")
    single = groups.where("weight = 1").select("rep", "length", "weight", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends"))
    out = materialise(single.unionByName(several), "sequences")
    discard(sums, groups)
    return out


def refine(turns: DataFrame, sequences: DataFrame, root: int) -> list[DataFrame]:
    """Per depth from 1: conv_id (a sequence's rep), depth, length, weight, parent and label of its classes, points, and the class's n (members) and k (sequences)."""
    active = sequences.where("length > 0").select(F.col("rep").alias("conv_id"), "length", "weight", F.lit(root).cast("bigint").alias("parent"))
    levels: list[DataFrame] = []
    while True:
        depth = len(levels) + 1
        met = turns.where(F.col("depth") == depth).join(active.hint("merge"), "conv_id")
        classes = met.groupBy("parent", "digest").agg(F.min("conv_id").alias("label"), F.sum("weight").alias("n"), F.count("*").alias("k"))
        level = met.join(classes.hint("merge"), ["parent", "digest"]).select("conv_id", "depth", "length", "weight", "parent", "label", "points", "n", "k")
        level = materialise(level, "level")
        levels.append(level)
        active = level.where("k > 1 and length > depth").select("conv_id", "length", "weight", F.col("label").alias("parent"))
        if active.isEmpty():
            return levels


def chains(turns: DataFrame, retired: DataFrame) -> DataFrame:
    """The nodes below the classes of one sequence, with all that is to know of them."""
    tail = turns.join(retired.select("conv_id", "length", "weight", F.col("depth").alias("from")).hint("merge"), "conv_id").where("depth > from")
    tail = tail.withColumn("run", F.floor(F.col("depth") / RUN)).withColumn("gain", (F.col("weight") - 1) * F.col("points"))
    # sums from a node to its chain's end: within runs of RUN turns, then over the runs behind
    copied = tail.where("weight > 1")
    behind = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = copied.groupBy("conv_id", "run").agg(F.sum("gain").alias("gain")).select("conv_id", "run", F.coalesce(F.sum("gain").over(behind), F.lit(0)).alias("later"))
    within = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth"))
    summed = copied.withColumn("sum", F.sum("gain").over(within)).join(runs.hint("merge"), ["conv_id", "run"]).withColumn("saved", F.col("sum") + F.col("later"))
    columns = ["conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("n_convs"), (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves")]
    plain = tail.where("weight = 1").select(*columns, F.lit(0).cast("bigint").alias("saved_tokens"), "from")
    return plain.unionByName(summed.select(*columns, F.col("saved").alias("saved_tokens"), "from"))


def fold(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, n_convs, gain) with what their children (parent_conv_id, n_leaves, saved_tokens) hand up."""
    up = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    rows = nodes.join(up.hint("merge"), "conv_id", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("gain") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ids: conv_id of all conversations, each once, also those without turns. turns: conv_id, depth (1, 2, ... in
    each conversation), digest, points. Equal turns have equal digests. Without conversations there is no root.
    """
    turns = materialise(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns")
    ids = materialise(ids, "ids")
    root, total = ids.agg(F.min("conv_id"), F.count("*")).first()
    spark = ids.sparkSession
    if root is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    sequences = distinct_sequences(ids, turns)
    levels = refine(turns, sequences, root)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    retired = every.where("k = 1 and length > depth")
    tails = materialise(chains(turns, retired), "chains")

    folded, below = [], tails.where("false").drop("from")
    for depth in range(len(levels), -1, -1):
        if depth:
            nodes = levels[depth - 1].where("conv_id = label").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("points")).alias("gain"))
        else:
            nodes = spark.createDataFrame([(root, 0, None, total, 0)], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, gain bigint")
        children = below.unionByName(tails.where((F.col("depth") == depth + 1) & (F.col("from") == depth)).drop("from"))
        below = materialise(fold(nodes, children), "folded")
        folded.append(below)
    nodes = tails.drop("from")
    for level in folded:
        nodes = nodes.unionByName(level)

    ending = every.where("length = depth").select(F.col("label").alias("conv_id"), "depth", F.col("conv_id").alias("rep"))
    ending = ending.unionByName(retired.select("conv_id", F.col("length").alias("depth"), F.col("conv_id").alias("rep")))
    ending = ending.unionByName(sequences.where("length = 0").select(F.lit(root).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), "rep"))
    ends = ending.join(sequences.select("rep", "ends").hint("merge"), "rep").select("conv_id", "depth", "ends")
    out = nodes.join(ends.hint("merge"), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
v AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(list_reduce(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM v, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(f.own, [])[1:h], h.own[h + 1:]) AS seq FROM h LEFT JOIN v f ON f.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
g AS (SELECT depth, seq[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, seq[1:depth]),
c AS (SELECT x.depth, x.path, count(y.conv_id) AS n_children, any_value(x.conv_id) AS conv_id FROM g x LEFT JOIN g y ON y.depth = x.depth + 1 AND y.path[1:x.depth] = x.path GROUP BY x.depth, x.path),
e AS (SELECT g.*, n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS gain FROM g JOIN c USING (depth, path)),
u AS (SELECT depth, path, unnest(range(0, depth + 1)) AS up, gain, n_children = 0 AS leaf FROM e),
s AS (SELECT up, path[1:up] AS above, count(*) FILTER (leaf) AS n_leaves, CAST(sum(gain) AS BIGINT) AS saved_tokens FROM u GROUP BY up, path[1:up])
SELECT e.conv_id, e.depth, o.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM e JOIN s ON s.up = e.depth AND s.above = e.path LEFT JOIN g o ON o.depth = e.depth - 1 AND o.path = e.path[1:e.depth - 1]
"""

"""A prefix trie of conversations, built level by level.

A conversation is its turns in order; every conversation is first rebuilt from the head of the first one of its block of twenty, as asked.
Turns are numbered by one range-partitioned sort: a conversation that crosses partitions goes on counting from those before, of which
there is at most one a partition. A turn's role and text are one SHA-256 digest from there on; texts do not move again.

Down: per depth, the live conversations look up their next turn, are grouped by (parent node, next turn), and the least conv_id
of a group is the node's name (a conversation has one node a depth, so depth and name tell nodes apart). A conversation alone in
its node leaves the loop: below it there is one chain, written out at once. So there are as many turns of the loop as the longest prefix that two conversations share.
Groups are written before they are joined back, so that adaptive execution can split the group that a third of all conversations are in.
Up: from the deepest level, children are counted and their leaves and savings added to their parent's, one join a level.
The list of conversations that end in a node is hashed in pieces: sorted ranges of all ends are first joined to pieces of about 256 kB, and a node's pieces then pass
through one hash in order, which SHA-256 cannot do otherwise, without being held.

Edge cases: rows without a conv_id take no part; turns that are null come first, ties in turn go by role, then text (equal rows are
turns of their own); null roles and texts are empty, and an empty text has no words; no rows give no nodes, not even the root; an empty
first turn is a turn; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viatica.llm.base import cut, fresh_dir, table, task

WORD = r"[^\x20\x09-\x0D]+"
PIECE = 1 << 18
BLOCK = 4096
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, words long, len int"
ROLLED = "conv_id long, depth int, parent_conv_id long, n_convs long, len int, n_children long, n_leaves long, saved_tokens long"
NOTHING = hashlib.sha256(b"").hexdigest()


def ids_hash(conv_id: Column) -> Column:
    return F.sha2(conv_id.cast("string").cast("binary"), 256)


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from the head of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of each conversation within a sorted partition."""
    part = TaskContext.get().partitionId()
    last, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        sizes = np.diff(np.r_[starts, len(conv)])
        place = np.arange(len(conv)) - np.repeat(starts, sizes)
        if conv[0] == last:
            place[: sizes[0]] += n
        last, n = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), b.column("turn_key"), b.column("words")], names=["conv_id", "part", "place", "turn_key", "words"])


def numbered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 1, turn_key, words) of all turns, and (conv_id, n) of all conversations."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).filter("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    turns = own.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").select("conv_id", key.alias("turn_key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = cut(turns.mapInArrow(task(_places), "conv_id long, part int, place long, turn_key binary, words long"))
    runs = cut(turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    crossing = runs.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before")  # at most one a partition
    pos = (F.col("place") + F.coalesce("before", F.lit(0)) + 1).cast("int")
    return turns.join(F.broadcast(crossing), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "turn_key", "words"), runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(convs: DataFrame, block: int = 20, head: Column | None = None) -> DataFrame:
    """(conv_id, donor, taken, shift, len): a conversation's first `taken` turns are its donor's, then its own from pos = depth + shift."""
    own = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", head_length(F.col("conv_id")) if head is None else head)
    donors = convs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0))).cast("int")
    length = (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int")
    return own.join(donors, "donor", "left").withColumn("taken", taken).select("conv_id", "donor", "taken", (F.col("h") - F.col("taken")).alias("shift"), length.alias("len"))


class Levels:
    """Tables by level in one folder, read one at a time or all together."""

    def __init__(self, spark: SparkSession, what: str, kind: str):
        self.spark, self.path, self.kind = spark, fresh_dir(spark, what), kind

    def put(self, level: int, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/level={level}")

    def at(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/level={level}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/level=*")


def _level(live: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """The live conversations with the nodes they are in at this depth: (conv_id, ..., node, n_convs, parent_conv_id, words)."""
    taken = F.col("taken") >= depth
    asked = live.withColumn("source", F.when(taken, F.col("donor")).otherwise(F.col("conv_id"))).withColumn("pos", F.when(taken, F.lit(depth)).otherwise(depth + F.col("shift")))
    step = cut(asked.join(turns.withColumnRenamed("conv_id", "source"), ["source", "pos"]).drop("source", "pos").withColumnRenamed("node", "parent_conv_id"))
    groups = cut(step.groupBy("parent_conv_id", "turn_key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")))
    return cut(step.join(groups, ["parent_conv_id", "turn_key"]).drop("turn_key"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, conv_id, end) as pieces (depth, conv_id, first end, ends joined by commas)."""
    node, ends, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.int64()), pa.array([ends[0]], pa.int64()), pa.array([",".join(map(str, ends))])], names=["depth", "conv_id", "first", "ends"])

    for b in batches:
        for depth, conv, end in zip(*(b.column(c).to_pylist() for c in ("depth", "conv_id", "end")), strict=True):
            if ends and ((depth, conv) != node or size > PIECE):
                yield piece()
                ends, size = [], 0
            node = depth, conv
            ends.append(end)
            size += len(str(end)) + 1
    if ends:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (depth, conv_id, hash)."""
    node, h = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.int64()), pa.array([h.hexdigest()])], names=["depth", "conv_id", "ends_sha256"])

    for b in batches:
        for depth, conv, ends in zip(*(b.column(c).to_pylist() for c in ("depth", "conv_id", "ends")), strict=True):
            if (depth, conv) != node:
                if node is not None:
                    yield done()
                node, h = (depth, conv), hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
    if node is not None:
        yield done()


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of nodes by (depth, conv_id, end)."""
    keys = ["depth", "conv_id", "end"]
    pieces = ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(task(_pieces), "depth int, conv_id long, first long, ends string")
    return pieces.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(task(_hashed), "depth int, conv_id long, ends_sha256 string")


def trie(rows: DataFrame, block: int = 20, head: Column | None = None) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations. `head` (of conv_id) is how many turns come from the head of a block."""
    spark = rows.sparkSession
    placed, convs = numbered_turns(rows)
    path = fresh_dir(spark, "turns")
    band = F.floor(F.log2("pos")).cast("int")
    placed.withColumn("band", band).write.partitionBy("band").parquet(path)  # a level reads the turns of its band alone
    turns = spark.read.schema("conv_id long, pos int, turn_key binary, words long, band int").parquet(path)
    live = cut(rebuilt(convs, block, head))
    root, n = live.agg(F.min("conv_id"), F.count("*")).first()
    nodes, ends, closed = Levels(spark, "nodes", NODE), Levels(spark, "ends", "conv_id long, depth int, end long"), Levels(spark, "closed", "conv_id long, depth int, len int")
    final = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    if not n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    at = live.withColumns({"node": F.lit(root), "n_convs": F.lit(n), "parent_conv_id": F.lit(None).cast("long"), "words": F.lit(0).cast("long")})
    depth = 0
    while True:
        nodes.put(depth, at.filter("conv_id = node").select("conv_id", F.lit(depth).alias("depth"), "parent_conv_id", "n_convs", "words", "len"))
        ends.put(depth, at.filter(f"n_convs > 1 and len = {depth}").select(F.col("node").alias("conv_id"), F.lit(depth).alias("depth"), F.col("conv_id").alias("end")))
        closed.put(depth, at.filter(f"n_convs = 1 and len > {depth}").select("conv_id", F.lit(depth).alias("depth"), "len"))
        live = at.filter(f"n_convs > 1 and len > {depth}").select("conv_id", "donor", "taken", "shift", "len", "node")
        if live.isEmpty():
            break
        depth += 1
        bands = sorted({int(np.log2(p)) for p in range(depth, depth + 4)})
        at = _level(live, turns.filter(F.col("band").isin(bands) & F.col("pos").between(depth, depth + 3)).drop("band"), depth)
    rolled = Levels(spark, "rolled", ROLLED)
    for d in range(depth, -1, -1):
        own = nodes.at(d)
        if d < depth:
            kids = rolled.at(d + 1).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
            own = own.join(kids, "conv_id", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("kids", "leaves", "below")})
        alone = (F.col("n_convs") == 1) & (F.col("len") > d)  # a chain goes on below
        children = F.when(alone, F.lit(1)).otherwise(F.coalesce("kids", F.lit(0))).cast("long")
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("below", F.lit(0))
        rolled.put(d, own.select("conv_id", "depth", "parent_conv_id", "n_convs", "len", children.alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.alias("saved_tokens")))
    top = rolled.all().join(ends_hashed(ends.all()), ["depth", "conv_id"], "left")
    lone = F.when((F.col("n_convs") == 1) & (F.col("len") == F.col("depth")), ids_hash(F.col("conv_id"))).otherwise(F.lit(NOTHING))
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", lone)).withColumn("depth", F.col("depth").cast("long")).select(*final)
    blocks = closed.all().withColumn("from", F.explode(F.sequence(F.col("depth") + 1, F.col("len"), F.lit(BLOCK))))
    chain = blocks.withColumn("depth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + BLOCK - 1, F.col("len")))))
    last, one = F.col("depth") == F.col("len"), F.lit(1).cast("long")
    chain = chain.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, ids_hash(F.col("conv_id"))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    # the parent of a chain's first node is its closed node, which has the same name
    return top.unionByName(chain)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS done, 4294967295 AS v FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c.conv_id, c.s, c.done + 1, xor(c.v >> 8, t.v) FROM crc c JOIN crc_table t ON t.k = 8 AND t.i = xor(c.v, ascii(c.s[c.done + 1])) & 255 WHERE c.done < length(c.s)
), heads AS (
  SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE done = length(s)
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), counted AS (
  SELECT conv_id, h, least(h, (SELECT count(*) FROM turns d WHERE d.conv_id = c.conv_id - c.conv_id % 20)) AS taken FROM heads c
), rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, t.key, t.words FROM counted c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, c.taken + t.pos - c.h, t.key, t.words FROM counted c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
  SELECT conv_id, depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM counted
), ended AS (
  SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id
), nodes AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(p.words) AS saved,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (e.len = p.depth), '')) AS ends_sha256
  FROM paths p JOIN ended e USING (conv_id) GROUP BY p.depth, p.path
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.path, 32 * n.depth) = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 32 * (n.depth - 1))
)
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs, n.n_children, count(*) FILTER (s.n_children = 0) AS n_leaves,
  sum(s.saved)::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN linked s ON s.depth >= n.depth AND starts_with(s.path, n.path)
GROUP BY n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256
"""

"""Token counts from flat token files by a separator scan.

A token file holds ids one after another, each document closed by the end id, and nothing else: no header, no index. Files
are read in blocks of `block` ids, each by any task; a block's end ids are found by one vectorised comparison. Where a
document begins and which one it is follows from the blocks before: how many end ids they hold and where the last one
stands. Both are prefix scans over block summaries, done in two steps (within groups of blocks, then over the groups), so
that no task holds the summaries of a whole file. Ids after the last end id are a document of their own, not complete.

Edge cases: an empty file has no documents; a document may be empty, or span many blocks; a block may hold no end id.
For files written from documents: null and empty texts are empty documents; null ids are carried along; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, fresh_dir, open_files, partitions, slices, table, task
from viatica.llm.tokens import encoder, vocabulary

END = 49407
GROUP = 256


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Writes documents (doc_id, text) to flat files of 16-bit ids, one a task; gives (file, n_ids) and (file, nth, doc_id).

    Each attempt writes a file of its own name; only those of attempts that succeeded are named in the tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        files, root = open_files(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        files.create_dir(root, recursive=True)
        n, total = 0, 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in slices(batches, "text", 2 << 20):
                ids, first = encode(binaries(batch.column("text")))
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids of more than 16 bits")
                flat = np.insert(ids.astype("<u2"), first[1:], end)
                out.write(flat.tobytes())
                total += len(flat)
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column("doc_id").cast(pa.int64())], names=["file", "nth", "doc_id"])
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.array([total], pa.int64())], names=["file", "nth", "doc_id"])

    rows = cut(docs.select("doc_id", "text").mapInArrow(task(run), "file string, nth long, doc_id long"))
    return rows.filter("nth < 0").select("file", F.col("doc_id").alias("n_ids")), rows.filter("nth >= 0")


def scan_blocks(files: DataFrame, folder: str, end: int = END, block: int = 1 << 20, kind: str = "<u2") -> DataFrame:
    """(file, block, ends): where end ids stand in each block of files (file, n_ids), counted from the file's start."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_files(folder)
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block * width, n * block * width), kind)
                found = np.flatnonzero(ids == end) + n * block
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["file", "block", "ends"])

    blocks = files.filter("n_ids > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block}"))).alias("block"))
    spread = blocks.repartition(partitions(files.sparkSession), "file", "block")
    return spread.mapInArrow(task(run), "file string, block long, ends array<long>")


def document_lengths(files: DataFrame, folder: str, end: int = END, block: int = 1 << 20, kind: str = "<u2") -> DataFrame:
    """(file, nth, start, n_tokens, complete): the documents of token files, without their end ids."""
    found = cut(scan_blocks(files, folder, end, block, kind))
    whole = found.select("file", "block", F.expr(f"block div {GROUP}").alias("group"), F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"))
    groups = whole.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select("file", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(over), F.lit(-1)).alias("last_before"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = whole.join(carried, ["file", "group"]).select("file", "block", (F.col("n_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("nth_before"), F.coalesce(F.max("last").over(inside), "last_before").alias("last_before"))
    each = found.filter(F.size("ends") > 0).join(blocks, ["file", "block"])
    before = F.when(F.col("i") == 0, F.col("last_before")).otherwise(F.expr("ends[i - 1]"))
    rows = each.select("file", "nth_before", "last_before", "ends", F.posexplode("ends").alias("i", "at"))
    rows = rows.select("file", (F.col("nth_before") + F.col("i")).alias("nth"), (before + 1).alias("start"), (F.col("at") - before - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    totals = groups.groupBy("file").agg(F.sum("n").alias("nth"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = files.join(totals, "file").filter("n_ids > start").select("file", "nth", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return rows.unionByName(rest)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "tokens")
    files, order = write_token_files(table(spark, sf_dir, "documents"), vocabulary(), folder)
    return document_lengths(files, folder).join(order, ["file", "nth"]).select("doc_id", "n_tokens", "start", "complete")

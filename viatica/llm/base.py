"""What the operators of this subpackage share: reading, cutting lineage, Arrow helpers, hash splits."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.functions.lineage import kept as checkpointed
from viatica.functions.lineage import shared_dir

SPACES = b" \t\n\r\x0b\x0c"


def lean(spark: SparkSession) -> None:
    """Whole texts pass to Python in batches of about 4 MB (Spark's own default is 64), for workers share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def others(df: DataFrame, *left_out: str) -> Column:
    """The other columns as one struct, to be carried past Python whatever their names."""
    own = [c for c in df.columns if c not in left_out]
    return packed([F.col(f"`{c}`") for c in own], own)


def packed(columns: list[Column], names: list[str]) -> Column:
    """Columns as one struct of these names, after a first field of a name that none of them has, for Arrow has no struct without fields."""
    free = "_" * (1 + max((len(n) for n in names), default=0))
    return F.struct(F.lit(True).alias(free), *[c.alias(n) for c, n in zip(columns, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, so that no later loss of an executor repeats what stands before."""
    return checkpointed(df)


def fresh_dir(spark: SparkSession, what: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString()


def open_files(uri: str):
    """(file system, path) of a URI, for the flat files that Spark has no reader for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def binaries(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `most` bytes at most; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def slices_of(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 17, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to `rows` whose lists would hold about `most` numbers if all were as long as the longest; a longer list comes alone."""
    for batch in batches:
        at = 0
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0), dtype=np.int64)
        while at < batch.num_rows:
            own = np.maximum.accumulate(np.maximum(sizes[at : at + rows], 1))
            n = max(1, int(np.count_nonzero(own * np.arange(1, len(own) + 1) <= most)))
            yield batch.slice(at, n)
            at += n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict = {}
_USED: set = set()


def kept(key, make):
    """One value per key and Python worker: what a task has built serves the next ones. Only the latest key of each kind is kept."""
    kind = key[0]
    _USED.add(kind)
    if _KEPT.get(kind, (None,))[0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


def task(run):
    """run, leaving a lean worker behind: at the end, what other kinds of tasks have kept goes, and freed memory returns to the system.

    Workers outlive their tasks and share the executor's memory with the next ones, which may be of another operator.
    """

    def wrapped(batches):
        _USED.clear()
        try:
            yield from run(batches)
        finally:
            for kind in _KEPT.keys() - _USED:
                del _KEPT[kind]
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a libc without it frees as it will
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped

"""Line dedup over the corpus: which lines of which documents go, as a compressed keep bitmap per document.

Every line's key (stripped of white space, ASCII lower case) is hashed to 128 bits. The hashes are range-partitioned and
sorted by hash, document and position. Ranges are cut by the whole sort key, so a very common line spreads over as many
tasks as it needs. Each task streams its range and settles all runs of equal hashes that lie inside it; the first and
last run of a range, which may go on next door, are settled from their counts over all ranges (two runs a range at most).

Edge cases: a null text is empty, and an empty text is one empty line; a key of fewer than `least` code points is never
dropped; a document of which all lines go keeps an empty text; documents with equal ids count as one document, and
null ids as one more; repeated rows are treated alike; an empty table gives no rows; other columns pass unchanged, but for
own ones by the names n_lines and n_dropped, which give way to the new ones where these are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, cut, others, partitions, slices, SPACES, table, task

NO_ID = -(2**63)
LINES = "h1 long, h2 long, doc long, row long, pos int"
VERDICTS = "doc long, row long, pos int, h1 long, h2 long"
KEY = ["h1", "h2", "doc", "row", "pos"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(SPACES).lower() for x in text.split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, docs_, rows, places = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")), strict=True):
                found = [(n, xxhash.xxh3_128_digest(k)) for n, k in enumerate(line_keys(text)) if _long_enough(k, least)]
                hashes += [h for _, h in found]
                places += [n for n, _ in found]
                docs_ += [NO_ID if doc is None else doc] * len(found)
                rows += [_signed(xxhash.xxh64_intdigest(text, 42))] * len(found)
            h = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], names=KEY)

    return docs.select("doc_id", "text").mapInArrow(task(run), LINES)


class _Range:
    """One sorted range as it streams by. Rows are (h1, h2, doc, row, pos)."""

    def __init__(self, min_docs: int, first_stays: bool):
        self.min_docs, self.first_stays = min_docs, first_stays
        self.key: tuple | None = None
        self.opening = False  # is the open run the range's first?
        self.drop: list[np.ndarray] = []
        self.pending: list[np.ndarray] = []

    def _open(self, key: tuple) -> None:
        self.opening = self.key is None
        self.key, self.docs, self.last = key, 0, None
        self.held: list[np.ndarray] = []
        self.witness: np.ndarray | None = None  # the rows that settled the run as common

    def _extend(self, rows: np.ndarray) -> None:
        self.docs += int(np.count_nonzero(rows[1:, 2] != rows[:-1, 2])) + (self.last is None or rows[0, 2] != self.last)
        self.last = rows[-1, 2]
        if self.opening and self.first_stays:  # only the range before knows whether its first is here
            self.pending.append(rows)
        elif self.witness is not None:
            self.drop.append(rows)
        else:
            self.held.append(rows)
            if self.docs >= self.min_docs:
                self.witness, self.held = np.concatenate(self.held), []
                if self.opening:
                    self.pending.append(self.witness)
                else:
                    self.drop.append(self.witness[self.first_stays :])

    def _close(self, last: bool) -> None:
        if self.key is not None and (self.opening or last):
            self.pending += self.held
            if last and not self.opening and self.witness is not None:
                self.pending.append(self.witness)  # for the range after, which sees too few of this run

    def add(self, rows: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        ends = np.r_[starts[1:], len(rows)]
        if (rows[0, 0], rows[0, 1]) == self.key:
            self._extend(rows[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if not len(starts):
            return
        self._close(False)
        inner = slice(1 if self.key is None else 0, -1)
        if self.key is None and len(starts) > 1:
            self._open((rows[0, 0], rows[0, 1]))
            self._extend(rows[: ends[0]])
            self._close(False)
        if len(starts[inner]):  # whole runs, all at once
            fresh = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]
            docs = np.cumsum(fresh)
            common = docs[ends[inner] - 1] - docs[starts[inner]] + 1 >= self.min_docs
            a, n = starts[inner][common] + self.first_stays, (ends - starts)[inner][common] - self.first_stays
            self.drop.append(rows[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        self._open((rows[starts[-1], 0], rows[starts[-1], 1]))
        self._extend(rows[starts[-1] :])

    def taken(self) -> Iterator[pa.RecordBatch]:
        for parts, named in ((self.drop, False), (self.pending, True)):
            if parts:
                rows = np.concatenate(parts)
                none = pa.nulls(len(rows), pa.int64())
                hashes = [pa.array(rows[:, i].copy()) if named else none for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 2].copy()), pa.array(rows[:, 3].copy()), pa.array(rows[:, 4].astype(np.int32)), *hashes], names=["doc", "row", "pos", "h1", "h2"])
        self.drop, self.pending = [], []


def _stream(min_docs: int, first_stays: bool):
    """Over one sorted range: lines to drop, and, with their hash, lines of its first and last run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Range(min_docs, first_stays)
        for batch in batches:
            if batch.num_rows:
                state.add(np.stack([np.asarray(batch.column(n)).astype(np.int64) for n in range(5)], 1))
                yield from state.taken()
        state._close(True)
        yield from state.taken()

    return run


def dropped_lines(docs: DataFrame, min_docs: int, least: int, first_stays: bool) -> DataFrame:
    """(doc, row, pos) of every line that goes. row is the XXH64 of the text."""
    n = partitions(docs.sparkSession)
    ranged = hashed_lines(docs, least).repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    found = cut(ranged.mapInArrow(task(_stream(min_docs, first_stays)), VERDICTS))
    settled, pending = found.filter("h1 is null").select("doc", "row", "pos"), found.filter("h1 is not null")
    place = F.struct("doc", "row", "pos")
    common = pending.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("docs"), F.min(place).alias("first")).filter(F.col("docs") >= min_docs)
    # at most two runs a range are pending, so `common` has no more than 2 n rows
    late = pending.join(F.broadcast(common), ["h1", "h2"])
    if first_stays:
        late = late.filter(place != F.col("first"))
    return settled.unionByName(late.select("doc", "row", "pos"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, least: int = 1, first_stays: bool = False) -> DataFrame:
    """(doc, row, keep): for every document that loses lines, its keep bitmap: zlib over bits in line order, the highest bit of a byte first; lines past its end stay.

    Lines found in at least min_docs documents go: all of them, or with first_stays all but the first by id and position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for gone in batch.column("gone").to_pylist():
                bits = np.ones(-(-(max(gone) + 1) // 8) * 8, np.uint8)
                bits[gone] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(maps, pa.binary())], names=["doc", "row", "keep"])

    gone = dropped_lines(docs, min_docs, least, first_stays).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(task(run), "doc long, row long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, counted: bool = True) -> DataFrame:
    """docs with text cut to the lines that stay, and, if counted, n_lines and n_dropped. The texts are moved once, by document."""
    new = ["n_lines", "n_dropped"] if counted else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "whole"):
            texts, lines, dropped = [], [], []
            for text, keep in zip(binaries(batch.column("whole")), batch.column("keep").to_pylist(), strict=True):
                lines.append(text.count(b"\n") + 1)
                if keep is None:
                    texts.append(text)
                    dropped.append(0)
                    continue
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
                stay = np.ones(lines[-1], bool)
                stay[: len(bits)] = bits[: len(stay)]
                texts.append(b"\n".join([p for p, s in zip(text.split(b"\n"), stay.tolist(), strict=True) if s]))
                dropped.append(int(len(stay) - stay.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["d", "kept", "n_lines", "n_dropped"])

    keyed = docs.select(others(docs, "text").alias("d"), F.coalesce("text", F.lit("")).alias("whole"))
    keyed = keyed.select("d", "whole", F.coalesce("d.doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("whole").alias("row"))
    joined = keyed.join(bitmaps, ["doc", "row"], "left").select("d", "whole", "keep")
    made = joined.mapInArrow(task(run), f"d {joined.schema['d'].dataType.simpleString()}, kept string, n_lines long, n_dropped long")
    return made.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c.lower() not in new], *new)


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, first_stays: bool = False, counted: bool = True) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, least, first_stays), counted)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY doc_id
"""

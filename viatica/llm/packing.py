"""Cost-balanced packing of documents into training sequences.

A document costs `linear` a token plus `quadratic` times its piece's length squared (attention sees no further than the
piece). Within a window of about `window` tokens, documents in descending order each go to the sequence of least cost
that still has room for them; one that fits nowhere is cut. The windows of a task follow its rows, so nothing is
shuffled and a task holds one window at a time, however large the table.

Edge cases: null and empty texts are documents of the end id alone; null ids are carried along; repeated rows are packed
once each; an empty table gives no rows; other columns are ignored. A document longer than a sequence fills whole
sequences first. Equal lengths keep their order. What is left of a window after the whole sequences goes to sequences of
descending powers of two, so none needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.llm.base import binaries, slices, table, task
from viatica.llm.tokens import encoder, vocabulary

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths; sequences count from 0."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for doc in np.flatnonzero(lengths >= capacity).tolist():
        for n in range(int(lengths[doc]) // capacity):
            pieces.append((doc, n * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    whole, tail = divmod(int(rest.sum()), capacity)
    sizes = [capacity] * whole + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    size = room.copy()
    order = np.argsort(-rest, kind="stable")
    for doc in order[: np.count_nonzero(rest)].tolist():
        at, left = int(lengths[doc] - rest[doc]), int(rest[doc])
        while left:
            best = int(np.where(room >= left, cost, np.inf).argmin())
            if room[best] < left:
                best = int(room.argmax())
            n = min(left, int(room[best]))
            pieces.append((doc, at, n, sequence + best, int(size[best] - room[best])))
            room[best] -= n
            cost[best] += linear * n + quadratic * n * n
            at, left = at + n, left - n
    return pieces


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 6144, window: int = 2_000_000) -> DataFrame:
    """Pieces of documents (doc_id, text) with their token ids (32 bits each, little-endian), as PIECES.

    1/6144 is the share of attention in a transformer layer of width 1024: quadratic cost over linear cost per token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 40
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, tokens
            rows = assign(np.array([len(x) for _, x in held], np.int64), capacity, linear, quadratic)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d, *_ in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([len(held[d][1]) for d, *_ in rows], pa.int64()),
                    pa.array([made + r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                    pa.array([held[d][1][a : a + n].tobytes() for d, a, n, *_ in rows], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            made += 1 + max(r[3] for r in rows)
            held, tokens = [], 0
            return out

        for batch in slices(batches, "text", 2 << 20):
            ids, first = encode(binaries(batch.column("text")))
            for n, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[first[n] : first[n + 1]], end_id).astype("<u4")
                held.append((doc, own))
                tokens += len(own)
                if tokens >= window:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(task(run), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), vocabulary()))

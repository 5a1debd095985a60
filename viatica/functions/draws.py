"""Random draws addressed by who they belong to: the ChaCha8 block function over columns of keys.

A run's seed, a stream, a design and a replication make the 32-byte key; up to four numbers of 32 bits (a traveller, a trip, an iteration, an alternative) make the address of a block of sixteen words.
So a draw does not depend on how rows are split, in what order they come, or what else is drawn. Addresses are not hashed: no two meet.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Streams by name.
STREAMS = {"demand_synthesis": 0, "demand_integerisation": 1, "departure_time": 2, "choice": 3, "msa_reselection": 4, "fleet_policy": 5, "disruption_jitter": 6}
TAG = b"viatica-rng-v1"  # 14 bytes that keep draws of one scheme apart from another's
CONSTANTS = np.frombuffer(b"expand 32-byte k", "<u4")
COLUMNS_THEN_DIAGONALS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def key(seed: int, stream: str | int, design: int = 0, replication: int = 0, tag: bytes = TAG) -> bytes:
    """The key of one stream of a run: seed, stream, design (0 where designs share their draws), replication and tag."""
    number = STREAMS[stream] if isinstance(stream, str) else stream
    if len(tag) != 14:
        raise ValueError("a tag has 14 bytes")
    return struct.pack("<QHII", seed, number, design, replication) + tag


def blocks(key_: bytes, stream: np.ndarray, counter: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The sixteen words of each block: a row for each 64-bit stream position and block counter."""
    stream, counter = np.asarray(stream, np.uint64), np.asarray(counter, np.uint64)
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    start = np.empty((16, len(stream)), np.uint32)
    start[:4] = CONSTANTS[:, None]
    start[4:12] = np.frombuffer(key_, "<u4")[:, None]
    start[12], start[13], start[14], start[15] = counter & low, counter >> high, stream & low, stream >> high
    x = start.copy()
    for _ in range(rounds // 2):
        for a, b, c, d in COLUMNS_THEN_DIAGONALS:
            for u, v, w, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                x[u] += x[v]
                x[w] ^= x[u]
                x[w] = (x[w] << np.uint32(turn)) | (x[w] >> np.uint32(32 - turn))
    return (x + start).T


def addressed(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stream positions and counters of addresses of one to four numbers: one and two in the position, the third and fourth in the counter."""
    p = [np.asarray(x, np.uint64) for x in parts]
    join = lambda a, b: (a << np.uint64(32)) | b
    none = np.zeros(len(p[0]), np.uint64)
    if len(p) == 1:
        return p[0], none
    return join(p[0], p[1]), none if len(p) == 2 else p[2] if len(p) == 3 else join(p[2], p[3])


def word(key_: bytes, *columns: str | Column, index: int = 0) -> Column:
    """The word at `index` of the block at the address of one to four columns (numbers of 32 bits), as a long; null where one is null."""
    if not 1 <= len(columns) <= 4:
        raise ValueError("an address has one to four parts")

    @F.pandas_udf("long")
    def drawn(frame: pd.DataFrame) -> pd.Series:
        whole = frame.notna().all(axis=1).to_numpy()
        own = [frame.iloc[:, i].to_numpy()[whole].astype(np.int64) for i in range(frame.shape[1])]
        if any(len(x) and (x.min() < 0 or x.max() >> 32) for x in own):
            raise ValueError("an address is of numbers from 0 to 2^32 - 1")
        out = pd.Series(pd.array([None] * len(frame), "Int64"))
        if whole.any():
            out[whole] = blocks(key_, *addressed(*own))[:, index].astype(np.int64)
        return out

    return drawn(F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("long").alias(f"p{i}") for i, c in enumerate(columns)]))


def unit(w: Column) -> Column:
    """In [0, 1), from a word."""
    return w / float(1 << 32)


def open_unit(w: Column) -> Column:
    """In (0, 1): never an end, so its logarithm is finite."""
    return (w + 0.5) / float(1 << 32)


def gumbel(w: Column) -> Column:
    return -F.ln(-F.ln(open_unit(w)))


def exponential(w: Column) -> Column:
    return -F.ln(open_unit(w))


def bernoulli(w: Column, p: Column | float) -> Column:
    return unit(w) < p


def index_below(w: Column, n: Column | int) -> Column:
    """A whole number from 0 to n - 1: the word's share of n."""
    return F.shiftright(w * n, 32)

"""The block function against published key streams, and addresses over columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from viatica.functions import draws

# Key streams for a key, a nonce and a counter of zeros, by rounds, as published.
STREAMS = {
    8: "3e00ef2f895f40d67f5bb8e81f09a5a12c840ec3ce9a7f3b181be188ef711a1e984ce172b9216f419f445367456d5619314a42a3da86b001387bfdb80e0cfe42",
    20: "76b8e0ada0f13d90405d6ae55386bd28bdd219b8a08ded1aa836efcc8b770dc7da41597c5157488d7724e03fb8d84a376a43b8f41518a11cc387b669b2ee6586",
}


@pytest.mark.parametrize("rounds", [8, 20])
def test_published_streams(rounds):
    got = draws.blocks(bytes(32), np.zeros(1), np.zeros(1), rounds)
    assert got.astype("<u4").tobytes().hex() == STREAMS[rounds]


def plain(key, stream, counter):
    """One block, a word at a time."""
    mask = 0xFFFFFFFF
    start = [*draws.CONSTANTS.tolist(), *np.frombuffer(key, "<u4").tolist(), counter & mask, counter >> 32, stream & mask, stream >> 32]
    x = list(start)
    for _ in range(4):
        for a, b, c, d in [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]:
            for u, v, w, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                x[u] = (x[u] + x[v]) & mask
                y = x[w] ^ x[u]
                x[w] = ((y << n) | (y >> (32 - n))) & mask
    return [(a + b) & mask for a, b in zip(x, start, strict=True)]


def test_addresses(spark):
    key = draws.key(7, "choice", replication=2)
    assert len(key) == 32 and key[:8] == (7).to_bytes(8, "little") and key[8:10] == b"\x03\x00" and key[14:18] == b"\x02\x00\x00\x00" and key[18:] == draws.TAG
    rows = [(412_002, 3, 7, 19), (0, 0, 0, 0), (2**32 - 1, 1, 2**32 - 1, 5), (1, 2, 3, None)] + [(n, n % 3, 1, n % 5) for n in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").repartition(5)
    out = df.select("*", draws.word(key, "a").alias("w1"), draws.word(key, "a", "b").alias("w2"), draws.word(key, "a", "b", "c").alias("w3"), draws.word(key, "a", "b", "c", "d", index=2).alias("w4")).collect()
    for r in out:
        assert r.w1 == plain(key, r.a, 0)[0] and r.w2 == plain(key, r.a << 32 | r.b, 0)[0] and r.w3 == plain(key, r.a << 32 | r.b, r.c)[0]
        assert r.w4 == (None if r.d is None else plain(key, r.a << 32 | r.b, r.c << 32 | r.d)[2])
    assert len({r.w4 for r in out}) > 290
    with pytest.raises(Exception, match="from 0 to"):
        df.select(draws.word(key, F.col("a") - 5)).collect()
    with pytest.raises(ValueError):
        draws.key(1, "choice", tag=b"short")


def test_what_words_become(spark):
    df = spark.range(20_000).select(draws.word(draws.key(1, "msa_reselection"), "id").alias("w"))
    w = F.col("w")
    r = df.agg(F.avg(draws.unit(w)), F.min(draws.open_unit(w)), F.max(draws.open_unit(w)), F.avg(draws.gumbel(w)), F.avg(draws.exponential(w)), F.avg(draws.bernoulli(w, 0.3).cast("int")), F.min(draws.index_below(w, 7)), F.max(draws.index_below(w, 7)), F.countDistinct("w")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 < r[1] and r[2] < 1 and abs(r[3] - 0.5772) < 0.03 and abs(r[4] - 1) < 0.03 and abs(r[5] - 0.3) < 0.015 and (r[6], r[7]) == (0, 6) and r[8] > 19_990

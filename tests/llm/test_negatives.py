from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from viatica.llm import negatives, queries


def brute(rows, every, positives=5, most=10, low=30, high=90):
    """Rows (vec_id, label, vector) by the definition."""
    good: dict = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append((label, [math.floor(256 * x) for x in v]))
    good = {i: min(v) for i, v in good.items()}
    out = []
    for a, (label, q) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, y, strict=False)), i, own == label) for i, (own, y) in good.items() if i != a)
        for ps, p, _ in [r for r in scored if r[2]][:positives]:
            hard = [(i, -s) for s, i, same in scored if not same and low * -ps <= 100 * -s <= high * -ps][:most]
            out += [(a, p, n + 1, i, -ps, s) for n, (i, s) in enumerate(hard)]
    return sorted(out)


def mined(df, every, **more):
    found = negatives.mine(negatives.whole_vectors(df), F.col("vec_id") % every == 0, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, d int, q string")


def test_ties_copies_and_edges(spark):
    random = np.random.default_rng(0)
    rows = [(i, int(random.integers(3)), [float(x) for x in random.normal(size=6).round(1)]) for i in range(150)]
    rows += [(200 + i, 1, [0.5, 0.5, 0.5, 0.0, 0.0, 0.0]) for i in range(60)] + [(300 + i, 2, [0.25, 0.25, 0.25, 0.0, 0.0, 0.0]) for i in range(40)]  # copies of one vector, ties beyond k
    rows += [rows[0], rows[10], rows[0]] + [(20, 0, [0.0] * 6), (30, 1, [])]  # repeated rows, one id twice
    rows += [(400, 1, None), (410, None, [1.0] * 6), (420, 1, [None] + [1.0] * 5), (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (450, 1, [1.0, 2.0]), (-10, 2, [0.3] * 9), (460, 7, [1.0] * 6)]
    df = frame(spark, rows)
    want = brute(rows, 10)
    assert len(want) > 300 and mined(df, 10) == want
    assert mined(df, 10, block_numbers=40) == want  # several blocks of anchors
    assert mined(df, 10, positives=2, negatives=3, windows=(50, 100)) == brute(rows, 10, 2, 3, 50, 100)
    assert mined(df.limit(0), 10) == [] and mined(df.filter("vec_id = 0"), 10) == [] and mined(df.filter("vec_id = 1"), 10) == []


def test_clusters_are_excluded_by_brackets(spark):
    """On vectors in clusters most pairs are never checked, and results are the same."""
    random = np.random.default_rng(1)
    centres = random.normal(size=(8, 16))
    x = np.concatenate([c + 0.02 * random.normal(size=(64, 16)) for c in centres])
    q = np.floor(256 * x)
    pivots = negatives.Pivots(q.tolist(), float((q * q).sum(1).max()), 8)
    block = negatives.Block(np.arange(0, 512, 64), np.zeros(8, np.int64), q[::64], pivots)
    d = pivots.of_rows(q)
    least, most = block.bracket(d, d, np.arange(8))
    exact = q[::64] @ q.T
    assert (least <= exact).all() and (exact <= most).all()
    near = exact >= np.sort(exact, 1)[:, -20:-19]
    assert (most >= np.sort(exact, 1)[:, -20:-19]).mean() < 0.4 and near.any()
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(512)]
    assert mined(frame(spark, rows), 64) == brute(rows, 64)


def test_query_is_its_sql(same):
    same(queries.QUERIES["op11_negatives"], queries.ORACLES["op11_negatives"])

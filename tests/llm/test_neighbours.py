from __future__ import annotations

import numpy as np

from viatica.llm import base, neighbours


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            best = sorted({(-float(x @ y), i) for i, y in good if i != q})[:k]
            out[q] = [i for _, i in best]
    return out


def test_edges_and_ties(spark):
    random = np.random.default_rng(0)
    rows = [(i, [float(x) for x in random.normal(size=4).round(3)]) for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties beyond k
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (205, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, shard int")
    got: dict = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=5, shard_size=30, beam=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 5)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert neighbours.nearest(few, few.filter("vec_id = 0"), k=5).count() == 2


def test_vectors_of_two_sizes(spark):
    """The size most vectors have counts, for the queries too, even if most of these have another; ties go to the larger."""
    rows = [(i, [float(i % 7), 1.0, 0.5]) for i in range(30)] + [(40 + i, [1.0, float(i)]) for i in range(21)] + [(20, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id >= 20")
    got = neighbours.nearest(df, asked, k=3).collect()
    want = brute([r for r in rows if len(r[1]) == 3], set(range(20, 30)), 3)
    assert {r.query_id for r in got} == set(want) and all([r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == v for q, v in want.items())
    even = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in neighbours.valid_vectors(even).collect()} == {3, 4}


def test_recall(spark):
    rows = base.table(spark, "/root/testdata/sf0.1", "embeddings")
    found = neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"), shard_size=700).toPandas()
    t = rows.toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)
    hit = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        mine = found[found.query_id == ids[q]]
        hit.append(len(set(mine.vec_id) & set(ids[np.argsort(-s)[:20]])) / 20)
        assert np.allclose(mine.sort_values("rank").score, [x[np.flatnonzero(ids == v)[0]] @ x[q] for v in mine.sort_values("rank").vec_id])
    assert np.mean(hit) >= 0.9


def test_inserted_nodes_are_found():
    """Of a graph whose nodes were nearly all inserted, not linked by exact products."""
    x = np.random.default_rng(2).normal(size=(3000, 16))
    graph = neighbours.Graph(x, [[i] for i in range(len(x))], first=256)
    assert len(graph.layers) > 1 and all((layer < len(layer)).all() and (layer >= 0).any(1).all() for layer in graph.layers)
    found: dict = {}
    for i, v, s in graph.search(x[::50], np.arange(0, 3000, 50), 20, 128):
        found.setdefault(i, []).append(v)
        assert abs(s - float(x[v] @ x[50 * i])) < 1e-9
    hit = []
    for i, own in found.items():
        s = x @ x[50 * i]
        s[50 * i] = -np.inf
        hit.append(len(set(own) & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hit) >= 0.9

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viatica.llm import base, quality, queries


def test_tables_hold_a_pair_that_sums_cannot():
    """Labels that depend on two measures only together."""
    random = np.random.default_rng(0)
    x = random.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Additive()
    model.fit(x, y, pairs=2)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.95
    alone = quality.Additive()
    alone.fit(x, y, pairs=0)
    assert ((alone.score(x) >= 0.5) == (y > 0)).mean() < 0.7
    for row in x[:50]:  # the sum written out
        bins = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        raw = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        raw += sum(grid[bins[a] * model.coarse // len(model.tables[a]), bins[b] * model.coarse // len(model.tables[b])] for (a, b), grid in zip(model.pairs, model.grids, strict=True))
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-12)


def test_trees_are_the_best_cuts():
    random = np.random.default_rng(1)
    for _ in range(30):
        g, h = random.normal(size=7), random.uniform(1.5, 3, 7)
        loss = lambda a, b: -g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)  # noqa: B023, E731
        want = min((loss(0, c) + loss(c, 7), c) for c in range(1, 7))[1]
        assert quality.best_cut(g, h, 2.0)[1] == want
        steps = quality.tree(g, h, 2.0)
        assert len(np.unique(steps)) <= 4 and (-(g * steps) - 0.5 * (h + 0.5) * steps**2).sum() > 0
    grid, rows = random.normal(size=(4, 5)), random.uniform(1.5, 3, (4, 5))
    assert len(np.unique(quality.pair_tree(grid, rows, 2.0))) <= 4


def test_measures():
    got = dict(zip(quality.MEASURES, quality.measures("a a a. B|c1\n\nlong wörds##\nlong wörds##".encode()), strict=True))
    assert got["log_words"] == math.log1p(8) and got["repeated_next"] == 1 / 8 and got["distinct_words"] == 5 / 8 and got["repeated_lines"] == pytest.approx(1 / 3) and got["doubled_marks"] == 2 / 8
    assert quality.measures(b"") == quality.measures(b" \n ") == [0.0] * len(quality.MEASURES)
    assert all(math.isfinite(v) for v in quality.measures(bytes(range(256)) * 50_000))


def test_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    by_id: dict = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[1] == by_id[2] and by_id[3] == by_id[4] == by_id[5] and len(by_id[7]) == 1
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(s == {float(model.score(quality.measured([texts[i]]))[0])} for i, s in by_id.items())
    assert quality.score(empty, model).count() == 0 and quality.learn(empty, labels).score(quality.measured([b"x"]))[0] < 0.01
    good = labels.filter("doc_id in (1, 2)")
    assert quality.score(docs, quality.learn(docs, good)).agg(F.min("score")).first()[0] > 0.99  # one label
    held = {i for i in range(60) if base.fold_of(i, 5) == 0}
    told = spark.createDataFrame([(i, 0) for i in held], "doc_id long, quality int")
    assert quality.labelled_sample(docs, told, 10).count() == 0  # labels of held out rows are not read


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op12_quality"](spark, sf).join(base.table(spark, sf, "labels").filter("quality is not null").select("doc_id", "quality"), "doc_id").toPandas()
    held = found[found.held_out]
    assert {base.fold_of(i, 5) == 0 for i in held.doc_id} == {True} and set(found[~found.held_out].doc_id.map(lambda i: base.fold_of(i, 5) == 0)) == {False}
    assert len(held) > 500 and (held.predicted == (held.score >= 0.3)).all()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert good.predicted.mean() > 0.99 and bad.predicted.mean() < 0.05

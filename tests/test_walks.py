"""Walks between places over a layer, against all pairs."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from viatica.operators import walks
from test_growth import grid, table


def test_walks_by_all_pairs(spark):
    rows = grid(9, 9, 3)
    layer = spark.createDataFrame(table(rows)).withColumnRenamed("free_s", "seconds")
    draw = random.Random(1)
    stops = [(n, draw.randrange(81)) for n in range(25)] + [(98, 777), (99, None)]
    parked = [(n, draw.randrange(81)) for n in range(40)] + [(97, 777), (96, None)]
    far = {(a, a): 0.0 for a in range(81)} | {}
    for _, a, b, s, _ in rows:
        far[a, b] = min(s, far.get((a, b), math.inf))
    for k in range(81):
        for i in range(81):
            for j in range(81):
                d = far.get((i, k), math.inf) + far.get((k, j), math.inf)
                if d < far.get((i, j), math.inf):
                    far[i, j] = d
    stops_ = spark.createDataFrame(stops, "stop long, node long")
    parked_ = spark.createDataFrame(parked, "parking long, node long")
    links, report = walks.parkings_with_stops(layer, parked_, stops_, 150)
    want = {(p, s): far[a, b] for p, a in parked if a is not None and a < 81 for s, b in stops if b is not None and b < 81 and far[a, b] <= 150}
    want[97, 98] = 0.0  # both at a node that the layer lacks: no walk is needed
    assert {(r.parking, r.stop): r.walk_s for r in links.collect()} == want
    served = {p for p, _ in want}
    assert tuple(report.first()) == (1, len(parked) - 1 - len(served), len(served))
    few = {(r.parking, r.stop) for r in walks.parkings_with_stops(layer, parked_, stops_, 150, most=2)[0].collect()}
    assert few == {(p, s) for p in served for _, s in sorted((w, s) for (q, s), w in want.items() if q == p)[:2]}
    paths = {(r.a, r.b): r.walk_s for r in walks.stop_footpaths(layer, stops_, 200).collect()}
    assert paths == {(s, t): far[a, b] for s, a in stops for t, b in stops if s != t and a is not None and b is not None and max(a, b) < 81 and far[a, b] <= 200}
    assert walks.stop_footpaths(layer, stops_.limit(0), 200).count() == 0


def test_snapped_by_all_pairs(spark):
    draw = random.Random(2)
    nodes = [(n, draw.uniform(-500, 500), draw.uniform(-500, 500)) for n in range(300)] + [(300, 0.0, 0.0), (301, 0.0, 0.0)]
    places = [(n, draw.uniform(-700, 700), draw.uniform(-700, 700)) for n in range(200)] + [(200, 0.0, 0.0)]
    got = {r.place: (r.node, r.snap_m) for r in walks.snapped(spark.createDataFrame(places, "place long, x double, y double"), spark.createDataFrame(nodes, "node long, x double, y double"), 40.0).collect()}
    want = {}
    for p, x, y in places:
        d, n = min((math.hypot(a - x, b - y), n) for n, a, b in nodes)
        if d <= 40:
            want[p] = (n, d)
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want) and got[200] == (300, 0.0)
    assert spark.createDataFrame(nodes, "node long, x double, y double").filter(F.col("node") < 0).count() == 0

"""Steps that once refused, or held whole, what grows: the same rows by the way for large tables."""

from __future__ import annotations

import numpy as np
import pandas as pd

from viatica.operators import services, trees, walks
from test_growth import grid, table


def test_walks_of_a_layer_too_large_to_broadcast(spark):
    layer = spark.createDataFrame(table(grid(9, 9, 3))).withColumnRenamed("free_s", "seconds")
    ends = spark.createDataFrame([(n,) for n in (0, 7, 40, 41, 777)], "node long")
    rows = lambda most: sorted(tuple(r) for r in walks.between_nodes(layer, ends, ends, 150, most_links=most).collect())
    assert rows(10) == rows(10_000) and len(rows(10)) > 5


def test_a_tree_holds_what_it_reaches():
    n = 50_000
    a, b = np.arange(n), np.arange(1, n + 1)
    line = pd.DataFrame({"link": a, "from_node": a, "to_node": b, "free_s": 1.0, "length_m": 10.0, "x": b, "y": 0, "from_x": a, "from_y": 0})
    roads = trees.Roads(line)
    tree = trees.Tree(roads, trees.Times(roads, 900), 100, 0.0, None, {110})
    assert tree.route(110) == list(range(100, 110)) and len(tree.known) < 20
    asked = []
    by = trees.ByBlock(lambda ids: asked.append(len(ids)) or np.ones(len(ids)), roads.ids)
    assert trees.Tree(roads, trees.Times(roads, 900), 100, 0.0, None, {110}, by).route(110) == tree.route(110) and sum(asked) == 1024


def test_dock_days_look_at_the_nearest_ways_only(spark):
    """A day tries few docks, so a pair of every two docks is not held in one place; what is held gives the same day."""
    docks = pd.DataFrame({"dock": range(60), "slots": 2, "bikes": 1})
    near = pd.DataFrame([(a, b, 60.0 + abs(a - b) % 7) for a in range(60) for b in range(60) if a != b], columns=["dock", "other", "walk_s"])
    legs = pd.DataFrame({"day": 0, "leg": range(40), "origin": 0, "destination": 5, "request_s": [3.0 * i for i in range(40)], "ride_s": 300.0})
    want = services.play_docks(docks, near.sort_values(["dock", "walk_s", "other"]), legs)
    got = services.dock_days(spark.createDataFrame(docks), spark.createDataFrame(near), spark.createDataFrame(legs), most=30).collect()
    assert sorted((r.leg, r.status, r.pickup, r.back, r.start_s) for r in got) == sorted((x[0], x[1], x[2], x[3], x[4]) for x in want)

"""Reach pruning between trips and nodes: as over written pairs, with none of them moved."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from viatica.operators import readings
from viatica.plans.catalog import QUERIES


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pruned_between_as_over_pairs(spark, k):
    draw = random.Random(k)
    trips = [(t, draw.randrange(6)) for t in range(80)]
    nodes = [(n, draw.randrange(5)) for n in range(30)]
    trips, nodes = (spark.createDataFrame(rows + rows[:5], f"{c} long, zone long") for c, rows in (("trip", trips), ("node", nodes)))
    ride = F.abs(F.col("node") * 13 - F.col("trip") * 7) % 6
    best, worst = ride + F.col("node") % 4, ride + F.col("node") % 4 + F.col("trip") % 3
    each = trips.join(nodes, "zone").select("trip", "node", ride.alias("ride_s"), best.alias("best_s"), worst.alias("worst_s"))
    want = sorted(tuple(r) for r in readings.prune_reach(each, k).collect())
    got = lambda most: sorted(tuple(r) for r in readings.prune_reach_between(trips, nodes, ["zone"], ride, best, worst, k, most).collect())
    assert got(1000) == got(3) == want and 80 < len(want) < each.distinct().count()


def test_no_pair_is_moved(spark):
    df = QUERIES["reach_pruned"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    tops = plan.split("BroadcastHashJoin")
    assert "Window" not in plan and "Exchange" not in tops[0] and len(tops) >= 4

"""Rules on tags, worked out once for ways that say the same."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from viatica.operators import ways
from viatica.plans.catalog import QUERIES


def _lanes(tags):
    return dict(zip("fb", ways.bus_lanes(tags, ways.way_direction(tags, ways.highway_class(tags["highway"]))), strict=True))


def test_once_each_as_for_every_way(spark):
    draw = random.Random(4)
    values = ["yes", "no", "-1", "lane", "opposite_lane", "designated|yes", "yes|designated|designated", "2", "3", "motorway", "primary", "roundabout", ""]
    rows = [(n, {k: draw.choice(values) for k in draw.sample([*ways.BUS_TAGS, "name"], draw.randint(0, 12))} if n else None) for n in range(400)]
    rows += [(1000 + n, t) for n, t in rows]
    df = spark.createDataFrame(rows, "way long, tags map<string,string>")
    want = {r.way: (r.f, r.b) for r in df.select("way", *[c.alias(n) for n, c in _lanes(F.col("tags")).items()]).collect()}
    for most in (10, 10_000):
        got = ways.once_each(df, F.col("tags"), ways.BUS_TAGS, _lanes, most)
        assert got.columns == ["way", "tags", "f", "b"] and {r.way: (r.f, r.b) for r in got.collect()} == want
    assert len(set(want.values())) > 5 and len(want) == 800


def test_bus_lanes_are_worked_out_apart_from_rows(spark):
    plan = QUERIES["bus_lanes_of_ways"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "try_cast" not in plan.lower() and "zip_with" not in plan.lower()

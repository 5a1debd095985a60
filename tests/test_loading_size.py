"""Loading by events: what can't start before the end is left out, and changes nothing."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from viatica.operators import simulation


@pytest.mark.parametrize("level", [2, 3, 4])
def test_scenarios_as_loaded_whole(spark, level):
    draw = random.Random(level)
    road = pd.DataFrame({"link": range(6), "free_s": 20.0, "headway_s": [1.0, 2.0, 1.0, 2.0, 1.0, 1.0], "storage_pcu": 8.0, "lag_s": 30.0})
    rows = [(s, 100 * s + v, p, k, float(t), w) for s in range(3) for v in range(90) for t, w in [(draw.randrange(60), draw.choice([1.0, 2.0]))] for p, k in enumerate(draw.sample(range(6), draw.randint(1, 4)))]
    routes = pd.DataFrame(rows, columns=["scenario", "vehicle", "pos", "link", "depart_s", "pcu"])
    df, links = spark.createDataFrame(routes), spark.createDataFrame(road)
    key = lambda x: (x[0], x[1], x[2])
    for end in (45.0, float("inf")):
        want = sorted(((s, *(int(x) for x in m[:3]), m[3], m[4]) for s, own in routes.groupby("scenario") for m in simulation.load(road, own, level, end)), key=key)
        assert sorted((tuple(r) for r in simulation.simulate(links, df, level, end).collect()), key=key) == want
    heads = df.groupBy("scenario", "vehicle").agg(F.min_by("link", "pos").alias("first"), F.min("depart_s").alias("depart_s"), F.first("pcu").alias("pcu"))
    assert simulation.can_start(heads, links, 10.0).count() < 0.6 * heads.count() and simulation.can_start(heads, links, 1e9).count() == heads.count()

"""Many rows at few places: work must not grow with the square of what shares a place. Each would take its time squared, for minutes or hours, if pairs were made of copies."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from viatica.operators import assembly, imports, network, readings, services, transit

N = 300_000


@pytest.fixture
def soon():
    began = time.monotonic()
    yield
    assert time.monotonic() - began < 100


def _at(spark, n, name, places=7):
    k = F.col("id")
    return spark.range(n).select(k.alias(name), (k % places * 10).alias("x"), (k % places * 20).alias("y"))


def test_nearest_node_of_copies(spark, soon):
    got = network.nearest_node(_at(spark, N, "point"), _at(spark, N, "node"), 100)
    assert got.agg(F.count("*"), F.min(F.col("node") == F.col("point") % 7), F.max("d2")).first()[:] == (N, True, 0)


def test_snap_trips_of_copies(spark, soon):
    links = spark.range(N).select(F.col("id").alias("from_node"), F.col("id").alias("to_node"), F.when(F.col("id") % 7 == 3, "motorway").otherwise("primary").alias("class"))
    got = readings.snap_trips(_at(spark, N, "point"), _at(spark, N, "node"), links, 1)
    assert got.agg(F.count("*"), F.min(F.col("node") == F.col("point") % 7)).first()[:] == (N, True)


def test_nearest_docks_of_copies(spark, soon):
    got = services.nearest(_at(spark, N, "point"), _at(spark, N, "dock"), 3, 400)
    assert got.agg(F.count("*"), F.min(F.col("dock") == F.col("point") % 7 + 7 * (F.col("n") - 1)), F.max("d2")).first()[:] == (3 * N, True, 0)


def test_nearest_docks_k_over_places(spark):
    docks = [(i, 40 * (i % 9), 30 * (i // 20)) for i in range(60)]
    points = [(i, 17 * i % 300, 23 * i % 110) for i in range(40)]
    got = services.nearest(spark.createDataFrame(points, "point long, x long, y long"), spark.createDataFrame(docks, "dock long, x long, y long"), 4, 70)
    want = []
    for p, x, y in points:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, d) for d, a, b in docks if (x - a) ** 2 + (y - b) ** 2 <= 4900)
        want += [(p, d, d2, n + 1) for n, (d2, d) in enumerate(near[:4])]
    assert sorted(tuple(r) for r in got.select("point", "dock", "d2", "n").collect()) == sorted(want)


def test_hubs_of_copies(spark, soon):
    resources = _at(spark, N, "resource").withColumn("own_hub", F.lit(None).cast("string"))
    got = assembly.hubs(resources, _at(spark, N, "id_").select(F.concat(F.lit("h"), F.lpad(F.col("id_").cast("string"), 6, "0")).alias("hub"), "x", "y"), 50)
    assert got.agg(F.count("*"), F.min(F.col("hub") == F.concat(F.lit("h00000"), (F.col("resource") % 7).cast("string")))).first()[:] == (N, True)


def test_neighbours_rank_at_shared_places(spark):
    docks = [(i, 30 * (i % 5), 40 * (i % 3)) for i in range(70)]
    got = services.neighbours(spark.createDataFrame(docks, "dock long, x long, y long"), 50)
    want = []
    for d, x, y in docks:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, o) for o, a, b in docks if o != d and (x - a) ** 2 + (y - b) ** 2 <= 2500)
        want += [(d, o, d2, n + 1) for n, (d2, o) in enumerate(near)]
    assert sorted(tuple(r) for r in got.select("dock", "other", "d2", "n").collect()) == sorted(want)


def test_neighbours_sort_places_not_pairs(spark):
    """What is sorted are a place's others, once for all that stand there."""
    plan = services.neighbours(_at(spark, 1000, "dock"), 400)._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(dock" not in plan


def test_access_does_not_pair_points_with_points(spark, soon):
    got = transit.stops_within(_at(spark, N, "point"), spark.createDataFrame([(1, 0, 0), (2, 10, 20), (3, 900, 0)], "stop long, x long, y long"), 25)
    assert got.groupBy("stop").count().collect() and got.agg(F.count("*")).first()[0] == sum((N - r + 6) // 7 * n for r, n in ((0, 2), (1, 2), (2, 1)))


def test_footpaths_between_copies(spark):
    stops = [(i, 10 * (i % 4), 0) for i in range(30)]
    got = transit.footpaths(spark.createDataFrame(stops, "stop long, x long, y long"), 15)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, (x - u) ** 2) for a, x, _ in stops for b, u, _ in stops if a != b and abs(x - u) <= 15)


def test_sites_of_copies(spark, soon):
    p = _at(spark, N, "parking").select("parking", (F.col("parking") % 2).alias("kind"), "x", "y", F.lit(3).alias("capacity"))
    got = {tuple(r) for r in imports.merge_sites(p, 5).select("parking", "x", "members").collect()}
    assert len(got) == 14 and {r[0] for r in got} == set(range(14)) and sum(r[2] for r in got) == N

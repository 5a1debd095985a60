"""What queries move and work out again, on tables made for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from viatica.operators import demand, network, readings, services


def _moved(df):
    """Rows written to shuffles by df's plan."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        if name.endswith("QueryStageExec"):
            plan.append(p.plan())
        m = p.metrics().get("shuffleRecordsWritten")
        total += m.get().value() if m.isDefined() else 0
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return total


def _counted(df):
    """df, and how often its rows were worked out."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            n.add(len(f))
            yield f

    return df.mapInPandas(count, df.schema), n


def test_equilibrium_works_demand_out_once(spark):
    links = spark.createDataFrame([(0, 1, 2, 1.0, 9.0), (1, 2, 1, 1.0, 9.0)], "link long, from_node long, to_node long, free_s double, capacity double")
    asked, n = _counted(spark.createDataFrame([(1, 2, 3.0), (2, 1, 4.0)], "origin long, destination long, people double"))
    assert {r.link: r.flow for r in network.static_assignment(links, asked).collect()} == {0: 3.0, 1: 4.0}
    assert n.value == 2


def test_cells_are_worked_out_once_and_opened_in_many_tasks(spark):
    cells, n = _counted(spark.createDataFrame([(1, 2, 700_003), (2, 1, 11)], "o long, d long, parts long"))
    trips = demand.trips_of(demand.integerise(cells, 7, 9), 25200, 7200, 9)
    tasks = trips.groupBy("o", "d", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert n.value == 2
    assert sum(r.n for r in tasks if r.o == 1) == 100_000 and len([r for r in tasks if r.o == 1]) > 1
    assert trips.filter("o = 1").agg(F.min("i"), F.max("i"), F.countDistinct("i")).first()[:] == (1, 100_000, 100_000)


def test_room_sorts_seconds_not_moves(spark):
    moves = spark.range(40_000).selectExpr("id % 2 as link", "id % 100 as enter_s", "id % 100 + 7 as exit_s", "1L as pcu")
    asks = spark.createDataFrame([(1, 0, 50), (2, 1, 120), (3, 0, -1)], "ask long, link long, at_s long")
    road = spark.createDataFrame([(0, 10, 3), (1, 10, 3)], "link long, storage_pcu long, lag_s long")
    room = readings.room_at(moves, asks, road)
    assert _moved(room) < 20_000
    rows = [(k % 2, k % 100, k % 100 + 7) for k in range(40_000)]
    count = lambda link, at, c: sum(1 for r in rows if r[0] == link and r[c] <= at)
    assert {r.ask: r.room_pcu for r in room.collect()} == {a: 10 + count(k, t - 3, 2) - count(k, t, 1) for a, k, t in ((1, 0, 50), (2, 1, 120), (3, 0, -1))}


def test_dock_bins_deal_events_out_once(spark):
    events = spark.range(30_000).selectExpr("id % 3 as dock", "id * 7919 % 5000 as at_s", "id % 2 as taken", "1 - id % 2 as returned")
    docks = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "dock long, bikes long")
    bins = services.dock_bins(events, docks, 900)
    assert _moved(bins) < 45_000
    bikes, want = {0: 1, 1: 2, 2: 3}, {}
    for dock, at, returned in sorted(((r.dock, r.at_s, r.returned) for r in events.collect()), key=lambda r: (r[0], r[1], -r[2])):
        row = want.setdefault((dock, at // 900), [0, 0, 0, bikes[dock]])
        bikes[dock] += 1 if returned else -1
        row[0], row[1], row[2], row[3] = row[0] + 1 - returned, row[1] + returned, bikes[dock], min(row[3], bikes[dock])
    assert {(r.dock, r.bin): [r.pickups, r.returns, r.bikes_end, r.bikes_min] for r in bins.collect()} == want

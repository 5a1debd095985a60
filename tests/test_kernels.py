"""Searches with turns, static equilibrium and loading by events, against brute force, known answers and invariants."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viatica.operators import network, search, services, simulation, statics
from viatica.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


def _grid(spark, n=4):
    links = network.grid(spark, n, 100).selectExpr("from_node * 100 + to_node as link", "from_node", "to_node", "length_m + (from_node * 7 + to_node * 3) % 11 * 10 as length_m")
    return links, spark.range(n * n).selectExpr("id as node", f"id % {n} * 100 as x", f"id div {n} * 100 as y")


def _brute(links, allowed, origin, at, seconds, extra=lambda _: 0.0, starts=None):
    """Least cost by last link, relaxed until nothing changes; clocks follow the cheapest."""
    best = {k: (seconds(k, at) + extra(k), at + seconds(k, at)) for k, (a, _) in links.items() if (a == origin if starts is None else k in starts)}
    again = True
    while again:
        again = False
        for i, o in allowed:
            if i in best:
                t = seconds(o, best[i][1])
                new = (best[i][0] + t + extra(o), best[i][1] + t)
                if new[0] < best.get(o, (math.inf,))[0] - 1e-9:
                    best[o], again = new, True
    out = {}
    for k, x in best.items():
        node = links[k][1]
        if x[0] < out.get(node, (math.inf,))[0]:
            out[node] = x
    return out


def test_searches_against_brute_force(spark):
    rows, nodes = _grid(spark)
    rows = rows.withColumn("free_s", F.col("length_m") / 10).withColumn("extra", (F.col("link") % 7).cast("double"))
    table = rows.collect()
    links = {r.link: (r.from_node, r.to_node) for r in table}
    free, extra = {r.link: r.free_s for r in table}, {r.link: r.extra for r in table}
    allowed = [(r.in_link, r.out_link) for r in network.turns(rows).collect()]
    assert all(links[i][0] != links[o][1] for i, o in allowed)  # no way back without a dead end
    pairs = spark.createDataFrame(list(itertools.permutations((0, 5, 10, 15), 2)), "origin long, destination long")
    got = {(r.origin, r.destination): r for r in search.one_to_many(rows, pairs, "free_s", nodes).collect()}
    for (o, d), r in got.items():
        assert abs(r.cost - _brute(links, allowed, o, 0.0, lambda k, _: free[k])[d][0]) < 1e-9
        assert links[r.links[0]][0] == o and links[r.links[-1]][1] == d and all(t in set(allowed) for t in itertools.pairwise(r.links))
    assert len(got) == 12 and search.one_to_many(rows, pairs, "free_s", nodes, bound=5.0).count() == 0
    rise = {(k, b): free[k] * (1 + 0.2 * ((k + b) % 4)) for k in free for b in range(4)}  # slow enough not to overtake
    seconds = lambda k, at: rise.get((k, int(at // 60)), free[k])
    times = spark.createDataFrame([(k, b, s) for (k, b), s in rise.items()], "link long, bin long, seconds double")
    asks = spark.createDataFrame([(1, 0, 10.0, [15, 3], None), (2, 5, 70.0, [15, 0, 5], None), (3, 1, 10.0, [15], 1)], "ask long, origin long, depart_s double, destinations array<long>, after long")
    found = {(r.ask, r.destination): r for r in search.in_time(rows, times, asks, "free_s", 60, nodes=nodes).collect()}
    assert set(found) == {(1, 15), (1, 3), (2, 15), (2, 0), (3, 15)}
    for (ask, d), r in found.items():
        origin, at, starts = {1: (0, 10.0, None), 2: (5, 70.0, None), 3: (1, 10.0, {o for i, o in allowed if i == 1})}[ask]
        want = _brute(links, allowed, origin, at, seconds, starts=starts)[d]
        assert r.arrive_s <= want[1] + 1e-6
        clock = at
        for k in r.links:
            clock += seconds(k, clock)
        assert abs(clock - r.arrive_s) < 1e-6
    assert found[3, 15].links[0] != 100  # 1 leads from 0 to 1; back to 0 is no turn
    static = spark.createDataFrame([], "link long, bin long, seconds double")
    for r in search.in_time(rows, static, asks.filter("ask < 3"), "free_s", 60, "extra", nodes).collect():
        origin = {1: 0, 2: 5}[r.ask]
        assert abs(r.cost - _brute(links, allowed, origin, 0.0, lambda k, _: free[k], extra.__getitem__)[r.destination][0]) < 1e-9


def test_ties_and_twins(spark):
    """On an even grid all ways of one length are equal: the order of nodes from the end decides, and a twin of the same cost is found."""
    links = network.grid(spark, 3, 100).selectExpr("from_node * 100 + to_node as link", "from_node", "to_node", "length_m")
    _, nodes = _grid(spark, 3)
    pairs = spark.createDataFrame([(0, 4), (0, 1)], "origin long, destination long")
    rows = search.with_twins(links, pairs, "length_m", 0.0, 3, nodes).orderBy("destination", "route").collect()
    assert [(r.destination, r.route, r.cost, r.links) for r in rows] == [(1, 0, 100.0, [1]), (4, 0, 200.0, [3, 304] if rows[1].links == [3, 304] else [1, 104]), (4, 1, 200.0, [1, 104] if rows[1].links == [3, 304] else [3, 304])]
    first = rows[1].links  # back from the end: the middle node with the lesser (x, y) wins: 3 is at (0, 100), 1 at (100, 0)
    assert first == [3, 304]
    assert search.with_twins(links, pairs, "length_m", 250.0, 9, nodes).filter("destination = 1 and route = 1").first().cost == 300.0


def test_static_strategies_find_the_equilibrium(spark):
    """Two parallel roads: equal times. One road: nothing to choose."""
    links = spark.createDataFrame([(1, 0, 1, 100, 10.0, 10.0), (2, 0, 2, 100, 6.0, 20.0), (3, 2, 1, 100, 6.0, 20.0)], "link long, from_node long, to_node long, length_m long, free_s double, capacity double")
    demand = spark.createDataFrame([(0, 1, 20.0), (0, 1, 5.0), (1, 1, 9.0), (0, 2, 0.0)], "origin long, destination long, people double")
    low, high = 0.0, 25.0
    time = lambda free, cap, x: free * (1 + 0.15 * (x / cap) ** 4)
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if time(10, 10, x) < 2 * time(6, 20, 25 - x) else (low, x)
    for strategy, turns, near in (("frank_wolfe", 4, 0.5), ("msa", 6, 3.0), ("sra", 4, 5.0)):
        got = statics.solve(links, demand, strategy, turns=turns)
        flow = {r.link: r.flow for r in got.links.collect()}
        assert abs(flow[1] - x) < near and abs(flow[1] + flow[2] - 25) < 1e-6 and flow[2] == pytest.approx(flow[3])
        assert got.reports[0].gap > got.reports[-1].gap >= -1e-9
        shares = statics.route_shares(got.routes).collect()
        assert sum(r.share for r in shares) == pytest.approx(1) and {tuple(r.links) for r in shares} == {(1,), (2, 3)}
    got = statics.solve(links, demand, "frank_wolfe", turns=12, tolerance=1e-2)
    assert got.converged and len(got.reports) < 12 and got.reports[-1].gap < 1e-2
    flows = {r.link: r.flow for r in statics.solve(links, demand, "free_flow", increments=5).links.collect()}
    x = 0.0
    for part in range(5):
        x += 5.0 if time(10, 10, x) < 2 * time(6, 20, 5.0 * part - x) else 0.0
    assert flows[1] == pytest.approx(x)
    with pytest.raises(ValueError, match="no strategy"):
        statics.solve(links, demand, "none")


def _road(rows):
    return pd.DataFrame(rows, columns=["link", "free_s", "headway_s", "storage_pcu", "lag_s"])


def _cars(n, path, every=1.0, start=0.0, first=0):
    return pd.DataFrame([(first + v, p, k, start + v * every, 1.0) for v in range(n) for p, k in enumerate(path)], columns=["vehicle", "pos", "link", "depart_s", "pcu"])


def test_point_queue_and_free_flow():
    moves = simulation.load(_road([(1, 10.0, 2.0, 99.0, 3.0)]), _cars(5, [1], 0.5), level=2)
    assert [m[3] for m in moves] == [0.0, 2.0, 4.0, 6.0, 8.0]  # entered no closer than the headway
    assert [m[4] for m in moves] == [10.0, 12.0, 14.0, 16.0, 18.0]
    moves = simulation.load(_road([(1, 10.0, 0.1, 99.0, 3.0), (2, 5.0, 2.0, 99.0, 3.0)]), _cars(4, [1, 2], 10.0), level=4)
    assert sorted((v, p, e, x) for v, p, _, e, x in moves) == [(v, p, v * 10.0 + 10 * p, v * 10.0 + 10 + 5 * p) for v in range(4) for p in (0, 1)]


def test_spillback_holds_back_and_waves_return():
    """A bottleneck behind a short link: it fills, the one before it fills, and room comes back a lag later at level 4."""
    road = _road([(1, 10.0, 1.0, 100.0, 4.0), (2, 2.0, 1.0, 3.0, 4.0), (3, 5.0, 10.0, 100.0, 4.0)])
    out = {lv: simulation.load(road, _cars(12, [1, 2, 3], 1.0), level=lv) for lv in (2, 3, 4)}
    for lv, moves in out.items():
        assert len(moves) == 36 and all(m[4] is not None for m in moves)
        held = sorted([(m[3], 1) for m in moves if m[2] == 2] + [(m[4] + (4.0 if lv == 4 else 0.0), -1) for m in moves if m[2] == 2])
        most = max(itertools.accumulate(x for _, x in held))
        assert most <= 3 if lv > 2 else most > 3
        for k in (1, 2, 3):  # first in, first out, and no closer than the headway
            order = sorted((m[3], m[4]) for m in moves if m[2] == k)
            assert [x for _, x in order] == sorted(x for _, x in order)
            assert all(b - a >= {1: 1.0, 2: 1.0, 3: 10.0}[k] - 1e-9 for a, b in itertools.pairwise(x for _, x in order))
    last = {lv: max(m[4] for m in moves if m[2] == 1) for lv, moves in out.items()}
    assert last[2] < last[3] <= last[4]


def test_merge_serves_who_has_waited_longest_and_locks_stand():
    road = _road([(1, 5.0, 1.0, 50.0, 1.0), (2, 5.0, 1.0, 50.0, 1.0), (3, 5.0, 4.0, 2.0, 1.0)])
    cars = pd.concat([_cars(6, [1, 3], 1.0), _cars(6, [2, 3], 1.0, 0.2, 100)], ignore_index=True)
    moves = sorted((m for m in simulation.load(road, cars, level=3) if m[2] == 3), key=lambda m: m[3])
    sides = [m[0] >= 100 for m in moves]
    assert len(moves) == 12 and all(a != b for a, b in itertools.pairwise(sides[2:]))  # turn by turn
    ring = _road([(1, 1.0, 0.1, 1.0, 0.0), (2, 1.0, 0.1, 1.0, 0.0)])
    stuck = pd.concat([_cars(1, [1, 2], first=0), _cars(1, [2, 1], first=1)], ignore_index=True)
    moves = simulation.load(ring, stuck, level=3)
    assert sorted((m[0], m[4]) for m in moves) == [(0, None), (1, None)]  # each waits for the other
    cut = simulation.load(_road([(1, 10.0, 1.0, 9.0, 0.0)]), _cars(3, [1], 20.0), end_s=35.0)
    assert sorted((m[0], m[4]) for m in cut) == [(0, 10.0), (1, 30.0)] or (1, 30.0) in [(m[0], m[4]) for m in cut]


def test_queries_run_over_all(spark):
    moves = QUERIES["loading_spillback"](spark, DATA).toPandas()
    links = spark.sql("select 1").sparkSession and QUERIES["link_bins_15min"](spark, DATA)
    assert moves.groupby(["scenario", "vehicle"]).ngroups == spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct().count() and links.count() > 0
    done = moves.dropna()
    assert (done.exit_s > done.enter_s).all() and np.isfinite(done.exit_s).all()
    free = QUERIES["loading_point_queues"](spark, DATA).toPandas()
    both = free.merge(moves, on=["scenario", "vehicle", "pos"])
    assert (both.exit_s_y.fillna(9e9) >= both.exit_s_x - 1e-6).mean() > 0.95
    for name in ("turn_route_twins", "earliest_arrivals_in_time", "least_generalised_costs", "routes_after_link", "static_self_regulated", "static_route_shares"):
        assert QUERIES[name](spark, DATA).count() > 0, name


def test_a_day_of_docks():
    docks = pd.DataFrame({"dock": [1, 2, 3], "slots": [1, 2, 1], "bikes": [1, 0, 1]})
    near = pd.DataFrame([(1, 2, 30.0), (2, 1, 30.0), (2, 3, 60.0), (1, 3, 90.0), (3, 2, 60.0)], columns=["dock", "other", "walk_s"]).sort_values(["dock", "walk_s"])
    legs = pd.DataFrame([(1, 1, 3, 0.0, 100.0), (2, 1, 3, 10.0, 500.0), (3, 2, 1, 5.0, 50.0), (4, 2, 3, 400.0, 10.0)], columns=["leg", "origin", "destination", "request_s", "ride_s"])
    got = {r[0]: r[1:] for r in services.play_docks(docks, near, legs)}
    assert got == {
        1: ("rode", 1, 2, 0.0, 160.0, 0.0, 60.0),  # finds dock 3 full
        2: ("rode", 3, 2, 100.0, 660.0, 90.0, 60.0),  # walks from 1 to 2 to 3, takes a bike there, and finds 3 full later
        3: ("no_bike", 3, None, 125.0, None, 120.0, 0.0),  # has tried three docks
        4: ("rode", 2, 3, 400.0, 410.0, 0.0, 0.0),  # takes the bike that 1 has left
    }
    none = services.play_docks(docks.assign(bikes=0), near, legs)
    assert {r[1] for r in none} == {"no_bike"}
    full = services.play_docks(pd.DataFrame({"dock": [1, 2], "slots": [3, 0], "bikes": [1, 0]}), near.head(0), legs[legs.leg == 1].assign(destination=2))
    assert full == [(1, "over_capacity", 1, 2, 0.0, 100.0, 0.0, 0.0)]


def test_dock_days_keep_their_bikes(spark):
    rows = QUERIES["dock_days"](spark, DATA).toPandas()
    assert len(rows) == len(set(zip(rows.day, rows.leg, strict=True))) and (rows.status == "rode").any()
    assert (rows[rows.status == "no_bike"].back.isna()).all()


def test_one_rule_of_self_regulated_steps(spark, monkeypatch):
    """The solver's steps are those of choice.self_regulated_steps over its gaps."""
    from viatica.operators import choice, statics

    links = spark.createDataFrame([(k, a, b, 1000.0, t, 40.0) for k, a, b, t in ((0, 0, 1, 10.0), (1, 0, 1, 11.0), (2, 0, 1, 14.0), (3, 0, 1, 12.5))], "link long, from_node long, to_node long, length_m double, free_s double, capacity double")
    demand = spark.createDataFrame([(0, 1, 150.0)], "origin long, destination long, people double")
    out = statics.solve(links, demand, "sra", turns=7)
    gaps = [r.gap for r in out.reports]
    rows = spark.createDataFrame([(1, n, g) for n, g in enumerate(gaps)], "run long, iteration long, gap double")
    want = [r.step for r in choice.self_regulated_steps(rows).orderBy("iteration").collect()]
    assert [round(r.step, 6) for r in out.reports[:-1]] == want[1:] and len({x < y for x, y in zip(gaps[1:], gaps, strict=False)}) == 2


def test_line_search_by_bisection(spark):
    from viatica.operators import statics

    rows = [(10.0, 40.0, 150.0, 0.0), (11.0, 40.0, 0.0, 90.0), (14.0, 30.0, 20.0, 80.0)]
    state = spark.createDataFrame(rows, "free_s double, capacity double, flow double, target double")
    slope = lambda a: sum((t - f) * s * (1 + 0.15 * ((f + a * (t - f)) / c) ** 4) for s, c, f, t in rows)
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    assert abs(statics.line_search(state) - low) <= 1 / 64**2
    assert statics.line_search(state.withColumn("target", F.col("flow"))) == 1.0
    assert statics.line_search(spark.createDataFrame([(10.0, 40.0, 0.0, 50.0), (20.0, 40.0, 50.0, 0.0)], state.schema)) == 1.0
